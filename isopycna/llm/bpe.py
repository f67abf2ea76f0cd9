"""BPE encoding and decoding by one walk over a trie of distinct words.

A prefix of a word has exactly one encoding, and its last token is the one
suffix ``t`` for which (last token of what stands before ``t``, ``t``) is a pair
that BPE itself leaves apart.  So every node of a trie of words needs only its
last token and the depth before that token.  The distinct words of a batch, in
order, are the trie laid out depth first; the states on the path from the root
are a stack, each follows from those above it, and a prefix that many words
share is encoded once.  The ids of a word are read off by walking back from its end.

The vocabulary file is a parameter; it is read by the driver and broadcast (its
size is that of a vocabulary, not of the data).  Texts are normalised and split
as the file says: NFC, white space to one blank, lower case without context,
then ``'s 't 're 've 'm 'll 'd``, runs of letters, single digits and runs of
anything else.  Strings of special tokens in a text are special tokens.

Null texts count as empty; an empty text has no ids and decodes to the empty
string; rows that repeat are encoded each for itself; other columns are kept
where asked for; an empty table gives no rows; a text of any length is encoded as a
whole, in memory in proportion to it.  Decoding joins the tokens of the ids with blanks, as a file
without a decoder demands.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import documents

END_OF_WORD = "</w>"
#: Words whose ids a worker remembers, and token pairs; then it forgets them all.
WORDS_KEPT = 300_000
PAIRS_KEPT = 600_000
NEVER = 1 << 60
#: White space of Unicode.
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
#: From here on, scripts are split by the library that reads the file, whose tables of letters may be newer or older.
OTHER_SCRIPTS = re.compile("[^\x00-ԯ -⁯₠-₿]")


# The characters by which byte-level vocabularies write bytes; printable ones stand for themselves, others for those from 256 on.
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return [chr(b) for _, b in sorted([(b, b) for b in plain] + [(b, 256 + i) for i, b in enumerate(rest)])]


class Vocabulary:
    def __init__(self, source: bytes):
        self.source = source
        spec = json.loads(source)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        ends = len(END_OF_WORD)
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(END_OF_WORD)}
        self.final = {t[:-ends]: i for t, i in self.ids.items() if t.endswith(END_OF_WORD)}
        #: For the last two characters of a token, the length of the longest such token.
        self.inner_most, self.final_most = {}, {}
        for most, tokens in ((self.inner_most, self.inner), (self.final_most, self.final)):
            for t in tokens:
                most[t[-2:]] = max(len(t), most.get(t[-2:], 1))
        self.parts = {made: (rank, a, b) for (a, b), (rank, made) in self.merges.items()}
        self.whole: dict[int, bool] = {}
        self.spines: dict[int, list] = {}
        self.table = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.map = {i: c for i, c in enumerate(byte_alphabet())}
        self._reference = None
        self._words = None
        self.known: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}

    # -- pairs of tokens ---------------------------------------------------------

    def _symbols(self, token: int) -> list[int]:
        text = self.tokens[token]
        if text.endswith(END_OF_WORD) and text != END_OF_WORD:
            text = text[: -len(END_OF_WORD)]
            return [self.ids[c] for c in text[:-1]] + [self.ids[text[-1] + END_OF_WORD]]
        return [self.ids[c] for c in text]

    def _is_whole(self, token: int) -> bool:
        """Whether BPE makes ``token`` of its own symbols."""
        got = self.whole.get(token)
        if got is None:
            parts = self._symbols(token)
            while len(parts) > 1:
                rank, made, at = min((*self.merges.get(p, (NEVER, 0)), i) for i, p in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [made]
            got = self.whole[token] = parts == [token]
        return got

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The outermost token on one side of ``token`` over time, from a symbol on: (token, rank of the merge that ends it)."""
        key = token << 1 | side
        got = self.spines.get(key)
        if got is None:
            got, ends = [(token, NEVER)], token
            while ends in self.parts:
                rank, *halves = self.parts[ends]
                ends = halves[side]
                got.append((ends, rank))
            got.reverse()
            self.spines[key] = got
        return got

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge ever joins the end of ``a`` and the start of ``b``.

        Merges happen in the order of rank, on a tie from the left.  So the
        tokens that meet at the border change in the order of the ranks that
        end them, and each pair that meets has its own rank to come first.
        """
        key = a << 20 | b
        got = self.apart.get(key)
        if got is None:
            left, right = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            got = self._is_whole(b)
            while got:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = self.merges.get((x, y), (NEVER, 0))[0]
                if rank < x_ends and rank <= y_ends and rank < NEVER:
                    got = False
                elif x_ends == y_ends == NEVER:
                    break
                elif x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.apart) >= PAIRS_KEPT:
                self.apart.clear()
            self.apart[key] = got
        return got

    # -- the trie ----------------------------------------------------------------

    def _learn(self, words: list[str]) -> None:
        """Encode distinct words, in order: a walk of their trie, depth first.

        ``last`` and ``back`` are the states of the nodes on the path from the
        root: the last token of the prefix and the depth before that token.
        What a word shares with the one before it is not walked again.
        """
        shown_as = self.map
        shown = sorted(("".join(map(shown_as.__getitem__, w.encode())), w) for w in words)
        last, back, previous = [-1], [0], ""
        inner, final, inner_most, final_most = self.inner, self.final, self.inner_most, self.final_most
        apart, stay, whole = self.apart, self._stay_apart, self._is_whole
        for text, word in shown:
            n = len(text)
            depth, most = 0, min(n - 1, len(previous), len(last) - 1)
            while depth < most and text[depth] == previous[depth]:
                depth += 1
            del last[depth + 1 :], back[depth + 1 :]
            while depth < n:
                depth += 1
                tokens, reach = (final, final_most) if depth == n else (inner, inner_most)
                start = depth - reach.get(text[depth - 2 : depth], 1) if depth > 1 else 0
                if start < 0:
                    start = 0
                while True:
                    token = tokens.get(text[start:depth])
                    if token is not None:
                        if start:
                            ok = apart.get(last[start] << 20 | token)
                            if stay(last[start], token) if ok is None else ok:
                                break
                        elif whole(token):
                            break
                    start += 1
                last.append(token)
                back.append(start)
            ids = []
            at = n
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
            del last[-1], back[-1]
            previous = text

    # -- texts -------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        if self._words is None:
            import regex

            self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")
        if not text.isascii():
            if OTHER_SCRIPTS.search(text):
                return self._reference_words(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self._words.findall(BLANKS.sub(" ", text).lower())

    def _reference_words(self, text: str) -> list[str]:
        if self._reference is None:
            from tokenizers import Tokenizer

            self._reference = Tokenizer.from_str(self.source.decode())
            self._bytes = {c: i for i, c in self.map.items()}
        t = self._reference
        return [bytes(map(self._bytes.__getitem__, w)).decode() for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and "<" in text else [text]
            split.append([p if p in self.special else self.words(p) for p in parts if p])
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = {w for parts in split for p in parts if isinstance(p, list) for w in p}
        self._learn(new.difference(self.known))
        known, special = self.known, {t: struct.pack("<I", i) for t, i in self.special.items()}
        return [b"".join([y for p in parts for y in (map(known.__getitem__, p) if isinstance(p, list) else (special[p],))]) for parts in split]

    def forget(self) -> None:
        self.known.clear()
        self.apart.clear()

    def decode(self, ids: bytes) -> str:
        """The text of ids, little-endian unsigned 32-bit integers."""
        return " ".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(shared.value)
    return _loaded[key]


def read_vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_tokens`` (long), ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded``."""
    shared = read_vocabulary(docs.sparkSession, path)
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            texts = textkit.filled(batch.column(len(keep)))
            for first, last in textkit.chunks(texts):
                got = vocabulary.encode(texts.slice(first, last - first).to_pylist())
                ids = pa.array(got, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, last - first) for i in range(len(keep))),
                     pa.array([len(x) // 4 for x in got], pa.int64()), ids, pa.array([*map(vocabulary.decode, got)], pa.string())],
                    [*keep, "n_tokens", "ids", "decoded"],
                )
        # The worker lives on; what it knows of words goes with the task, the vocabulary stays.
        vocabulary.forget()

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(textkit.lean(run), f"{fields}, n_tokens long, ids binary, decoded string")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the binary column ``ids`` (null: null)."""
    shared = read_vocabulary(rows.sparkSession, path)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        vocabulary = _vocabulary(shared)
        return column.map(lambda x: None if x is None else vocabulary.decode(bytes(x)))

    return rows.withColumn("decoded", text(F.col(ids)))


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    out = encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


QUERIES = {"op4_bpe": op4_bpe}
