"""BPE encoding by dynamic programming over prefixes, and decoding.

In byte-pair encoding every prefix of a word has one encoding, so one number a
prefix is enough: its last token.  Going through the word, the automaton over the
vocabulary reports all tokens that end here; token t is the last one if the prefix
before it is empty or ends in a token that is compatible with t, that is, the two,
encoded together, stay the two.  Back-pointers from the whole word give the ids.
No merge is ever carried out.

Words repeat, so each worker keeps what it has worked out for up to MAX_WORDS words;
a word that isn't kept is worked out anew.  Rows are independent: one narrow pass, no
shuffle, and memory bounded by the batch and that table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_tokens import byte_letters

#: Words whose ids a worker keeps.
MAX_WORDS = 400_000
NEVER = 1 << 60
#: Scripts whose letters, digits and lower case no Unicode version sees differently.
USUAL = regex.compile(r"[\x00-\u024f\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u20a0-\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch


class Vocabulary:
    """Tokens, merge ranks and splits of a tokenizers BPE file with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.token = [names[i] for i in range(max(names) + 1)]
        ids = model["vocab"]
        self.rank, self.parts, self.joined = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, ab = ids[a], ids[b], ids[a + b]
            self.joined[a, b] = r
            self.rank[ab], self.parts[ab] = r, (a, b)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.splitter = Tokenizer.from_file(path)
        self.byte = byte_letters()
        self.letter = {b: c for c, b in byte_letters().items()}
        self.fits = functools.lru_cache(1 << 18)(self._fits)
        self._automaton(ids)

    def _automaton(self, ids: dict[str, int]) -> None:
        # A word's last letter carries the word end: it becomes one letter of its own.
        self.found = ahocorasick.Automaton()
        real = {}
        for i in sorted(ids.values(), key=lambda i: self.rank.get(i, -1)):
            a, b = self.parts.get(i, (None, None))
            # A token that its own text would not be encoded as can never be a last token.
            real[i] = i not in self.parts or real[a] and real[b] and self._fits(a, b, self.rank[i])
            if real[i]:
                text = self._letters(self.token[i])
                self.found.add_word(text, (i, len(text)))
        self.found.make_automaton()

    def _letters(self, token: str) -> str:
        if self.end and token.endswith(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def _fits(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a and b side by side stay apart (through all merges ranked below before).

        a's right edge is, in the course of merging, each token down a's right parts,
        and b's left edge each one down b's left parts.  Merges come in the order of
        their ranks; two edges that are there at the same time merge if their pair's
        rank comes before either is taken up into something larger (at equal ranks the
        pair further left goes first)."""
        left, gone_left = a, NEVER
        right, gone_right = b, NEVER
        while True:
            r = self.joined.get((left, right))
            if r is not None and r < before and r < gone_left and r <= gone_right:
                return False
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            # Back in time to where the edge that was made last was still in parts.
            if made_left > made_right:
                gone_left, left = made_left, self.parts[left][1]
            else:
                gone_right, right = made_right, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        if not data:
            return []
        text = "".join(self.letter[x] for x in data)
        if self.end:
            text = text[:-1] + chr(ord(text[-1]) + 0x1000)
        last, fits = [None] * (len(text) + 1), self.fits  # of each prefix: (token, length)
        for at, hit in self.found.iter(text):  # by end; at one end the longest comes first
            if last[at + 1] is None:
                before = last[at + 1 - hit[1]]
                if hit[1] == at + 1 or before is not None and fits(before[0], hit[0]):
                    last[at + 1] = hit
        ids, at = [], len(text)
        while at:
            token, n = last[at]
            ids.append(token)
            at -= n
        return ids[::-1]

    def text_words(self, text: str):
        """Words of a text and, as ints, the special tokens in it."""
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                yield self.special[piece]
            elif USUAL(piece):
                yield from self.words.findall(plain(piece))
            else:
                # Unicode versions differ on rare letters: the file's own normaliser and
                # splitter cut such a text, as bytes' letters; the rest goes on as usual.
                cut = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(piece))
                yield from (bytes(map(self.byte.__getitem__, w)).decode("utf-8") for w, _ in cut)


def plain(text: str) -> str:
    """NFC, runs of white space as one space, lower case letter by letter."""
    if not text.isascii():
        # Lower case of capital sigma depends on its place in str.lower(), not letter by letter.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(path: str, value):
    """A function from text to the list of value(ids) of its words, with a bounded memory."""
    vocab, kept = vocabulary(path), {}

    def encode(text: str) -> list:
        out = []
        for word in vocab.text_words(text):
            got = kept.get(word)
            if got is None:
                if len(kept) >= MAX_WORDS:
                    kept.clear()
                got = kept[word] = value([word] if isinstance(word, int) else vocab.encode_word(word), vocab)
            out.append(got)
        return out

    return encode


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of every whole text; null and empty texts have none."""

    def run(batches):
        ids_of = _encoded(tokenizer, lambda ids, _: ids)
        for batch in batches:
            ids = [[i for word in ids_of(t.as_py() or "") for i in word] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows (doc_id, ids) with text: the tokens, special ones too, joined by spaces, as
    the file names no decoder."""

    def run(batches):
        token = np.array(vocabulary(tokenizer).token, object)
        for batch in batches:
            text = [" ".join(token[np.array(x.as_py() or [], np.int64)]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: what encode and
    then decode give, digested in the same pass so that no ids leave the worker.

    Null text counts as empty (no tokens, digests of the empty string); repeated rows come
    out as often as they go in; a null id stays null; an empty table gives no rows; other
    columns are not looked at."""

    def value(ids, vocab):
        return len(ids), " ".join(map(str, ids)), " ".join(vocab.token[i] for i in ids)

    def run(batches):
        parts_of = _encoded(tokenizer, value)
        sha = lambda words: hashlib.sha256(" ".join(words).encode("utf-8")).hexdigest()
        for batch in batches:
            n, ids, text = [], [], []
            for t in batch.column(1):
                parts = parts_of(t.as_py() or "")
                n.append(sum(p[0] for p in parts))
                ids.append(sha([p[1] for p in parts]))
                text.append(sha([p[2] for p in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
