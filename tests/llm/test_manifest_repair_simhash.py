"""Merkle manifest, conversation repair and SimHash join against brute force, and on odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskmart.llm import catalog, conversation_repair as CR, merkle_manifest as MM, simhash_join as SJ

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, _other long, f long, leaf int, digest string"
TURNS = "conv_id long, turn long, role string, text string, head int, fault string, row long"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ Merkle manifest

def leaf(r, cut=False):
    text = r["text"]
    if cut and text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
        text = text.replace("\n", "")
    parts = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def climb(hashes):
    """Root and, per place, the (siblings before, after) of each level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = level[at[i] // 3 * 3: at[i] // 3 * 3 + 3]
            p.append((run[:at[i] % 3], run[at[i] % 3 + 1:]))
            at[i] //= 3
        level = [sha("".join(level[k:k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf(r) for r in groups[s]]) for s in names}
    root, top = climb([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, top):
        for r, path in zip(groups[s], trees[s][1]):
            folded, proof = leaf(r, True), ""
            for before, after in path + above:
                proof += "".join(before + after)
                folded = sha("".join(before) + folded + "".join(after))
            out.append((r["doc_id"], leaf(r), trees[s][0], root, sha(proof), folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"b": 10, "ä": 4, "Z": 1, None: 28, "": 3}])
def test_manifest_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(MM, "BROADCAST_NODES", 20)             # lower bands by shuffled joins
    monkeypatch.setattr(MM, "BAND", 2)
    rng, rows = random.Random(1), []
    for s, n in sizes.items():
        rows += [{"doc_id": rng.choice([None, rng.randrange(500)]), "text": rng.choice([None, "", "x\ny\n", "é\n漢" * 50]),
                  "lang": rng.choice([None, "de"]), "source": s, "n_chars": rng.choice([None, 5])} for _ in range(n)]
    rows += rows[:2]                                           # repeated rows are leaves of their own
    df = spark.createDataFrame([tuple(r.values()) + ("x", 1, 2, 3, "y") for r in rows], DOCS)
    assert manifest_rows(MM.document_manifest(df)) == brute_manifest(rows)


def test_manifest_of_the_table(spark):
    out = catalog.QUERIES["op11_merkle_manifest"](spark, SF)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert manifest_rows(out) == brute_manifest(rows)
    assert MM.document_manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_any_changed_leaf_is_found(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    m = MM.build(rows, group_col="g", order_cols=["id"], digest_col="d")
    bad = m.leaves.withColumn("claimed", F.when(F.col("id") == 41, F.sha2(F.lit("other"), 256)).otherwise(F.col("d")))
    m.leaves = bad
    out = MM.verify(m, id_col="id", group_col="g", digest_col="d", claimed_col="claimed")
    assert [r.id for r in out.filter("NOT verified").collect()] == [41] and out.count() == 100


# ------------------------------------------------------------------ conversation repair

GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(turns):
    """Dijkstra over (turn, roles so far as a state): least cost, then least audit, and the repaired roles."""
    def state(roles):
        return roles if len(roles) < 2 else ("s" if roles[0] == "s" else "") + ("u" if roles[-1] == "u" else "ua")

    def viable(roles):
        return any(GRAMMAR.fullmatch(roles + end) for end in ("", "a", "ua"))

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(turns) and GRAMMAR.fullmatch(roles):
            return cost, audit, "\n".join(out)
        if (at, roles, audit) in seen:
            continue
        seen.add((at, roles, audit))
        for r, name in (("u", "user"), ("a", "assistant")):
            if viable(roles + r):
                heapq.heappush(heap, (cost + 3, audit + "I", at, state(roles + r), (*out, f"{name}:")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and viable(roles + role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, state(roles + role[:1]), (*out, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if viable(roles + r):
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, state(roles + r), (*out, f"{name}:{text}")))


def faults(rows):
    """Rows (turn, role, text) of a conversation in order -> (role, text, fault)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out, seen = [], set()
    for _, role, text in rows:
        words = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_repair(rows):
    turns = faults(rows)
    kinds = [f for *_, f in turns]
    firsts = [r[:1] for r, *_ in turns]
    numbers = {t for t, *_ in rows if t is not None}
    cost, audit, text = cheapest(turns)
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, sha(text))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = [" " if x is None else x for x in (conv, turn, role, text)]
        k = zlib.crc32(f"{s[0]}:{s[1]}".encode()) % 20
        role, text = "user" if k == 4 else s[2], "" if k == 1 else re.sub("[.!?]", "", s[3]) if k == 2 else s[3]
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(rest)
    return out


def repair_rows(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def random_turns(rng, n):
    role = lambda: rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", " "])
    text = lambda: rng.choice(["a.", "b!", "c", " \t\n", "", "ä?\x0b", "long. " * 50, "漢"])
    return [(rng.choice([None, *range(n + 2)]), role(), text()) for _ in range(n)]


@pytest.mark.parametrize("stretch", [CR.STRETCH, 3])
def test_repair_equals_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(CR, "STRETCH", stretch)
    rng = random.Random(stretch)
    convs = {c: random_turns(rng, rng.choice([1, 2, 3, 5, 8])) for c in [None, *range(60)]}
    rows = [(c, *t, 1, "x", 2) for c, ts in convs.items() for t in ts]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    if stretch == 3:                                   # stretches of at most three turns, taken in many ranges
        df = df.repartition(3)
    assert repair_rows(CR.repair(df)) == {c: brute_repair(ts) for c, ts in convs.items()}


def test_stretches_of_a_conversation_compose():
    rng = random.Random(5)
    for _ in range(200):
        turns = [(rng.choice("suat"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 14))]
        cuts = sorted(rng.sample(range(len(turns) + 1), min(3, len(turns))))
        tops = {0: (0, ())}
        for lo, hi in itertools.pairwise([0, *cuts, len(turns)]):
            paths = [{"entry": e, "top": t, "cost": c, "audit": a} for e in CR.TOPS for t, (c, a) in CR.parse(turns[lo:hi], e).items()]
            tops = CR.compose(tops, paths)
        whole = CR.parse(turns)
        assert {t: (c, "".join(p)) for t, (c, p) in tops.items()} == whole
        assert min(whole[t] for t in CR.ACCEPT if t in whole) == cheapest([(r, "", f) for r, f in turns])[:2]


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(1, i // 2, rng.choice(["user", "assistant"]), f"t{i}.") for i in range(12_000)]
    out = CR.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    turns = [(r, t, "") for _, _, r, t in sorted(rows, key=lambda r: (r[1], r[2], r[3]))]
    tops = CR.parse([(r[0], f) for r, _, f in turns])
    assert len(out) == 1 and (out[0].cost, out[0].audit) == min(tops[t] for t in CR.ACCEPT if t in tops)
    assert out[0].repaired_sha256 == CR._digest([(None, r, t, f) for r, t, f in turns], out[0].audit)


def test_damage_and_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute_repair(ts) for c, ts in by_conversation(damage(rows)).items()}
    want |= {r[0]: (0, 0, 0, 0, 0, 0, "", EMPTY_SHA) for r in rows if r[0] not in want}
    assert repair_rows(catalog.QUERIES["op12_conversation_repair"](spark, SF)) == want
    odd = [(None, None, None, None), (None, 3, "user", "a"), (7, None, "user", None), (7, None, "user", None), (8, 1, "", "x")] * 3
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, CR.damaged(df).collect()), key=repr) == sorted(damage(odd), key=repr)
    assert CR.repair(df.limit(0)).count() == 0


# ------------------------------------------------------------------ SimHash

def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def simhash_rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("leaf", [SJ.LEAF, 4])
def test_simhash_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(SJ, "LEAF", leaf)
    monkeypatch.setattr(SJ, "CHUNK", 7)
    rng = random.Random(2)
    vocab = [f"W{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one two", "ONE two", "a b c", "ÄB ä\x0bb c", "x" * 5000, " ".join(rng.choices(vocab, k=20_000))]
    for _ in range(40):
        w = rng.choices(vocab, k=rng.choice([5, 60, 400]))
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append("\n".join(v))
    rows = [(rng.choice([None, i, i]), t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "one two")]
    df = spark.createDataFrame([(d, t, None, "s", 1, "x", 2, 3, 4, "y") for d, t in rows], DOCS).repartition(3)
    assert simhash_rows(SJ.near_duplicates(df)) == brute_components(rows)
    assert SJ.near_duplicates(df.limit(0)).count() == 0


def test_simhash_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash_rows(catalog.QUERIES["op13_simhash_trie"](spark, SF))
    assert got == brute_components(rows)
    kept = SJ.without_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    assert kept.count() == len({c for *_, c in got})


@pytest.mark.parametrize("portion", [SJ.PORTION, 50])
def test_trie_traversal_finds_every_pair(monkeypatch, portion):
    monkeypatch.setattr(SJ, "PORTION", portion)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    near = [b ^ np.uint64(int(sum(1 << int(k) for k in rng.choice(64, 3)) % (1 << 64))) for b in base for _ in range(5)]
    all_ = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64), np.array([0, 1, 3, (1 << 64) - 1], dtype=np.uint64)]))
    got = [(int(a), int(b)) for i, j in SJ.trie_links(all_, all_, True, 0, 0) for a, b in zip(all_[i], all_[j])]
    want = {(int(a), int(b)) for a, b in itertools.combinations(all_, 2) if (int(a) ^ int(b)).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want
    x, y = all_[::2].copy(), all_[1::2].copy()
    got = [(int(a), int(b)) for i, j in SJ.trie_links(x, y, False, 0, 0) for a, b in zip(x[i], y[j])]
    assert sorted(got) == sorted((int(a), int(b)) for a in x for b in y if (int(a) ^ int(b)).bit_count() <= 2)
