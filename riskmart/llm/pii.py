"""PII (10): information-theoretic sanitisation, in DataFrame operations alone.

Base spans (e-mail, ip, card, phone) are the protected entities. A term t of a document that holds entity e
reveals of it ``pmi(t, e) = log(c N / (n_t n_e))`` of at most ``ic(e) = log(N / n_e)``, with document counts
over the whole corpus. Every entity is scored, also one of a single text; the estimate is lowered by ``BOUND``
standard errors of the logarithm of a count, ``1 / sqrt(m)`` for m different texts that hold both (copies of a
text are documents, but no further evidence). A term whose lower bound is ``GENERALISE`` of ic(e) or more
becomes a placeholder, at ``REMOVE`` it goes. Terms are words of any length; runs of scripts that are written
without blanks give every pair of neighbouring characters.

Positions come from splitting a text by the same pattern that extracts the matches: the lengths of the
gaps and matches add up to code-point offsets. The patterns are written without overlapping alternatives and with
possessive runs (each run is tried from its start or from the end of the previous match only), so they stay linear
on long runs of digits or word characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.common import stored, table

BOUND, GENERALISE, REMOVE = 1.6, 0.5, 0.9
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a text holds no valid match of the kind.
GUARDS = {
    "email": "contains(text, '@')",
    "ip": r"text rlike r'[0-9]\.[0-9]'",
    "card": r"text rlike r'[0-9](?:[\x20-]?[0-9]){15}'",
    "phone": r"text rlike r'\+[0-9]'",
}
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), q -> q rlike '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    # Luhn: every second digit from the right doubled, 9 taken off above 9
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + "
            f"CASE WHEN i % 2 = 1 THEN cast(substring(reverse({_DIGITS}), i, 1) AS int) "
            f"WHEN cast(substring(reverse({_DIGITS}), i, 1) AS int) > 4 THEN 2 * cast(substring(reverse({_DIGITS}), i, 1) AS int) - 9 "
            f"ELSE 2 * cast(substring(reverse({_DIGITS}), i, 1) AS int) END) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
#: Scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNBROKEN = (r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}"
             r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}")
UNBROKEN = rf"[{_UNBROKEN}&&[\p{{L}}\p{{M}}]]"
#: A run of letters and marks, of unbroken scripts or of others.
RUN = rf"{UNBROKEN}++|[\p{{L}}\p{{M}}&&[^{_UNBROKEN}]]++"
_SPANS = "array<struct<s:int,e:int,v:string>>"


def _find(pattern: str, guard: str = "true") -> str:
    """SQL: spans (start, end, value) of all matches of ``pattern`` in column ``text``, in code points."""
    gaps, hits = f"split(text, r'{pattern}', -1)", f"regexp_extract_all(text, r'{pattern}', 0)"
    # the outer transform binds gaps and hits once
    return (f"CASE WHEN {guard} THEN transform(array(named_struct('g', {gaps}, 'h', {hits})), z -> "
            f"CASE WHEN size(z.h) = 0 THEN cast(array() AS {_SPANS}) ELSE "
            f"aggregate(sequence(0, size(z.h) - 1), named_struct('at', 0, 'out', cast(array() AS {_SPANS})), "
            f"(a, k) -> named_struct('at', a.at + char_length(z.g[k]) + char_length(z.h[k]), 'out', concat(a.out, array(named_struct("
            f"'s', a.at + char_length(z.g[k]), 'e', a.at + char_length(z.g[k]) + char_length(z.h[k]), 'v', z.h[k])))), "
            f"a -> a.out) END)[0] ELSE cast(array() AS {_SPANS}) END")


def base_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and one array of valid spans per kind, over each whole text (null: empty)."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(kind, F.expr(_find(pattern, GUARDS[kind])))
    return out.select("doc_id", "text", *[F.expr(f"filter({k}, x -> {VALID[k]})").alias(k) for k in PATTERNS])


def _listed(kind: str, spans: str) -> Column:
    return F.transform(F.col(spans), lambda x: F.concat_ws(":", F.lit(kind), x.s.cast("string"), x.e.cast("string")))


def _entities() -> Column:
    """Distinct protected entities (kind:value) of a document."""
    named = [F.expr(f"transform({k}, x -> concat('{k}:', lower(x.v)))") for k in PATTERNS]
    return F.array_distinct(F.flatten(F.array(*named)))


def _terms(run: str) -> str:
    """SQL: terms of a run in the order of their places; term i of an unbroken run starts at its character i."""
    pairs = "transform(slice(u, 1, size(u) - 1), (c, i) -> concat(c, u[i + 1]))"
    return (f"CASE WHEN {run} rlike r'^{UNBROKEN}{{2}}' THEN transform(array(regexp_extract_all({run}, '(?s).', 0)), u -> {pairs})[0] "
            f"ELSE array(lower({run})) END")


def term_places(held: DataFrame) -> DataFrame:
    """(fp, term, s, e) of every place of a term in the different texts of ``held``, in code points."""
    runs = (held.select("fp", "text").dropDuplicates(["fp"])
            .select("fp", F.expr(f"posexplode(arrays_zip(split(text, r'{RUN}', -1), regexp_extract_all(text, r'{RUN}', 0)))").alias("k", "z"))
            .select("fp", "k", F.expr("z['0']").alias("g"), F.expr("z['1']").alias("h")).filter("h is not null"))
    before = F.sum(F.char_length("g") + F.char_length("h")).over(Window.partitionBy("fp").orderBy("k"))
    return (runs.withColumn("at", (before - F.char_length("h")).cast("int"))
            .select("fp", "at", F.posexplode(F.expr(_terms("h"))).alias("i", "term"), F.char_length("h").alias("n"))
            .select("fp", "term", (F.col("at") + F.col("i")).alias("s"),
                    (F.col("at") + F.expr(f"CASE WHEN term rlike r'^{UNBROKEN}{{2}}' THEN i + 2 ELSE n END")).alias("e")))


def disclosing_terms(held: DataFrame, places: DataFrame, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(fp, term, share): terms of a text that reveal at least ``GENERALISE`` of the information of one of its
    entities, with the largest share over its entities.

    ``held``: documents with base spans (fp, text and span arrays); ``places``: their terms; ``docs``: the whole corpus.
    """
    held = held.withColumn("entities", _entities())
    copies = held.groupBy("fp").agg(F.count("*").alias("copies"))
    each = held.select("fp", F.explode("entities").alias("entity")).distinct().join(copies, "fp")
    known = each.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_e"))
    # all entities that only one text holds have equal counts: one of them stands for the others
    pairs = (each.join(known, "entity").groupBy("fp", F.when(F.col("texts") > 1, F.col("entity")).alias("shared"))
             .agg(F.min("entity").alias("entity"), F.first("copies").alias("copies"), F.first("n_e").alias("n_e")))
    beside = stored(places.select("fp", "term").distinct().join(pairs.drop("shared"), "fp"), "beside")
    counts = beside.groupBy("entity", "term").agg(F.count("*").alias("m"), F.sum("copies").alias("c"), F.first("n_e").alias("n_e"))
    runs, unbroken = f"array_distinct(regexp_extract_all(text, r'{RUN}', 0))", f"text rlike r'{UNBROKEN}{{2}}'"
    words = docs.select(F.col(text_col).cast("string").alias("text")).select(F.expr(
        f"array_distinct(CASE WHEN {unbroken} THEN flatten(transform({runs}, x -> {_terms('x')})) "
        f"ELSE transform({runs}, x -> lower(x)) END)").alias("w"))
    often = words.select(F.explode("w").alias("w")).groupBy(F.xxhash64("w").alias("term_fp")).agg(F.count("*").alias("n_t"))
    n = docs.agg(F.count("*").alias("n"))                                # one row
    lower = F.log(F.col("c") * F.col("n") / (F.col("n_t") * F.col("n_e"))) - F.lit(BOUND) / F.sqrt("m")
    flagged = (counts.withColumn("term_fp", F.xxhash64("term")).join(often, "term_fp").join(F.broadcast(n))
               .filter("n > n_e").withColumn("share", lower / F.log(F.col("n") / F.col("n_e"))).filter(F.col("share") >= GENERALISE)
               .select("entity", "term", "share"))
    return beside.join(flagged, ["entity", "term"]).groupBy("fp", "term").agg(F.max("share").alias("share"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one span array per base kind, ``term`` spans (with ``v``: removed or generalised) and the
    sanitised text of every document.

    Null texts are empty and stay without spans; repeated rows are scored as copies of one text; terms that
    overlap a base span are part of it. Term spans are disjoint. An empty table gives no rows.
    """
    found = base_spans(docs, id_col=id_col, text_col=text_col)
    some = F.lit(False)
    for k in PATTERNS:
        some = some | (F.size(k) > 0)
    # the text is kept only where there is something to protect
    found = stored(found.withColumn("text", F.when(some, F.col("text"))), "spans")
    held = found.filter("text is not null").withColumn("fp", F.xxhash64("text"))
    places = stored(term_places(held), "places")
    flagged = disclosing_terms(held, places, docs, text_col=text_col)
    own = (places.join(flagged, ["fp", "term"])
           .select("fp", "s", "e", F.when(F.col("share") >= REMOVE, "removed").otherwise("generalised").alias("v"))
           .groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("s", "e", "v"))).alias("term")))     # a text's own places
    # rows without spans have no text and nothing to look up: they stay out of the join
    out = held.join(own, "fp", "left").drop("fp").unionByName(found.filter("text is null"), allowMissingColumns=True)
    taken = " OR ".join(f"exists({k}, y -> y.s < x.e AND x.s < y.e)" for k in PATTERNS)
    out = out.withColumn("term", F.expr(f"coalesce(filter(term, x -> NOT ({taken})), cast(array() AS {_SPANS}))"))
    # pairs of characters overlap by one: the later begins where the earlier ends
    out = out.withColumn("term", F.expr("transform(term, (x, i) -> named_struct('s', greatest(x.s, coalesce(get(term, i - 1).e, 0)), 'e', x.e, 'v', x.v))"))
    marks = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'v', '<{k.upper()}>'))" for k in PATTERNS)
    marks = f"concat({marks}, transform(term, x -> named_struct('s', x.s, 'e', x.e, 'v', if(x.v = 'removed', '', '<TERM>'))))"
    clean = (f"aggregate(array_sort({marks}), named_struct('at', 0, 'out', ''), (a, x) -> CASE WHEN x.s < a.at THEN a ELSE "
             f"named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), x.v)) END, "
             f"a -> concat(a.out, substring(text, a.at + 1)))")
    out = out.withColumn("clean", F.expr(f"CASE WHEN text IS NOT NULL THEN {clean} END"))
    return out.select("doc_id", *PATTERNS, "term", F.col("clean").alias("sanitised"))


def op10_disclosure_sanitiser(spark, sf_dir: str) -> DataFrame:
    """Spans of every document; ``sanitised_crc32`` tells the sanitised text of documents with spans."""
    out = sanitise(table(spark, sf_dir, "documents"))
    base = F.array_join(F.flatten(F.array(*[_listed(k, k) for k in PATTERNS])), ",")
    every = F.array_join(F.flatten(F.array(*[_listed(k, k) for k in [*PATTERNS, "term"]])), ",")
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
                      F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
                      F.crc32("sanitised").alias("sanitised_crc32"))
