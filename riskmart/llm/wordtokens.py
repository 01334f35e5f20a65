"""Tokenisation of whole texts with the tokenizers library, one distinct word at a time.

The ``word_bpe_49k`` tokenizer drops white space and never merges across it, so a text's ids are the
concatenation of the ids of its blank-separated words (and of their letters and closing punctuation). Each
Python worker keeps the ids of the words it has met, and the library is asked once per new word (in
batches). The cache is emptied when it is full; that costs time, never results. ``tests/llm`` checks the ids against plain ``encode`` calls.
"""

from __future__ import annotations

import re

import numpy as np

#: Words kept by one Python worker (about 200 bytes each).
CACHE_WORDS = 600_000
#: id added after every document by the packing and binary-output operators.
END_ID = 1
#: Punctuation that may follow a word of letters (no apostrophe, which the tokenizer's contractions use, and
#: no character of the special tokens).
TAIL = ".,;:!?()[]{}\"-*/\\&%$#@+=~^_`"
#: Letters of Latin scripts, without U+0130, whose lower case ends in a combining dot.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A run of that punctuation between a letter and a blank: such a run is a pre-token of its own.
CUT = re.compile(f"[{re.escape(TAIL)}](?<=[{LETTER}].)[{re.escape(TAIL)}]*(?=[ \\n]|\\Z)")
#: Words that the tokenizer's normaliser leaves as they are: lower-case letters of Latin-1.
NORMAL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


def _pieces(text: str) -> list[str]:
    """Blank-separated words, their punctuation apart. Texts of Latin-1 alone are lower-cased here, which the
    tokenizer does anyway (there one letter for one), so that fewer words differ; not near special tokens."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return CUT.sub(r" \g<0>", text).replace("\n", " ").split(" ")


class WordEncoder:
    """Encode texts to little-endian uint16/uint32 id bytes.

    ``literal_specials``: strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, literal_specials: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = literal_specials
        self.normal = Tokenizer(self.tok.model)           # for NORMAL words: nothing to normalise, cut at blanks
        self.normal.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.vocab, dtype=bool)      # ids that end a pre-token
        for piece, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")
        self.cache: dict[str, bytes] = {"": b""}

    def _learn(self, new: set[str]) -> None:
        """Ids of words not met before. A word of letters is one pre-token: these are encoded as one
        blank-joined text and cut after each word-end id; all others go one by one."""
        normal, letters, rest = [], [], []
        for w in new:
            (normal if NORMAL(w) else letters if w.isalpha() else rest).append(w)
        for tok, words in ((self.normal, normal), (self.tok, letters)):
            for i in range(0, len(words), 5000):
                part = words[i:i + 5000]
                ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(part) or cuts[-1] != len(ids):       # a letter whose lower case is not one letter
                    rest += part
                    continue
                raw, at, step = ids.tobytes(), 0, self.dtype.itemsize
                for w, c in zip(part, (cuts * step).tolist()):
                    self.cache[w] = raw[at:c]
                    at = c
        for i in range(0, len(rest), 5000):
            part = rest[i:i + 5000]
            self.cache.update((w, np.array(e.ids, self.dtype).tobytes())
                              for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Id bytes (``self.dtype``) of each text; a null text has none."""
        out = []
        for i in range(0, len(texts), 256):
            split = [_pieces(t or "") for t in texts[i:i + 256]]
            new = set().union(*split).difference(self.cache)
            if new:
                if len(self.cache) + len(new) > CACHE_WORDS:
                    self.cache = {"": b""}
                    new = set().union(*split).difference(self.cache)
                self._learn(new)
            look = self.cache.__getitem__
            out += [b"".join(map(look, ws)) for ws in split]
        return out


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, literal_specials: bool = False) -> WordEncoder:
    """The encoder of this Python process; its word cache lasts over the tasks of a reused worker."""
    key = (path, literal_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, literal_specials)
    return _ENCODERS[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
