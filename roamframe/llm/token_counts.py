"""Token counts by a two-tier lookup of pre-tokens in the map tasks.

The library cuts a text into pre-tokens by a fixed pattern and encodes each by itself, so the count of
a text is the sum over its pre-tokens. The lengths of the most frequent pre-tokens are a table of fixed
size that every task receives; the others are encoded by the library once per worker and kept in its
cache. No pre-token is shuffled: a task of the first pass reports a summary of fixed size.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import text_or_empty

#: Pre-tokens that a task reports, that the broadcast table holds, that a worker counts and caches.
REPORTED, FREQUENT, COUNTED, CACHED = 4096, 65_536, 300_000, 400_000
# Fixed value: the pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points below are tried out when a worker starts, the others when a text first has them.
PROBED = 0x3000
_HIGH = regex.compile(rf"[{chr(PROBED)}-\U0010ffff]").findall
#: No pre-token has a space after a letter of another class, so a text can be cut before such a space.
_CUT = regex.compile(r"(?<=[!-~])(?=\x20)")

_workers: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter; bytes without one follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The library's tokenizer with the pattern beside it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.cache: dict[str, int] = {}
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.tried = bytearray(0x110000)
        odd = [c for c in map(chr, range(PROBED)) if self._odd(c)]
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.parts = [f"[{''.join(map(regex.escape, odd))}]"] * bool(odd) + [regex.escape(t.content) for t in special]
        self.strange = regex.compile("|".join(self.parts) or "(?!)")
        # A special token may reach over a space; texts with one are then not cut.
        self.cuttable = not any(t.rstrip or " " in t.content for t in special)

    def _odd(self, c: str) -> bool:
        """Whether the pattern and the library class the character differently; tried out once."""
        i = ord(c)
        if not self.tried[i]:
            probe = f"a{c}a1{c}1!{c}!  {c} x"
            same = [len(p.encode()) for p in self.pieces(probe)] == [len(p) for p, _ in self.cut(probe)]
            self.tried[i] = 1 if same else 2
        return self.tried[i] == 2

    def stretches(self, text: str):
        """(stretch, whether the pattern cuts it as the library does); cuts fall between pre-tokens."""
        high = "" if text.isascii() else "".join(sorted(c for c in set(_HIGH(text)) if self._odd(c)))
        strange = regex.compile("|".join([f"[{regex.escape(high)}]", *self.parts])) if high else self.strange
        done = 0
        for m in strange.finditer(text):
            if m.start() < done:
                continue
            low, end = 0, len(text)
            if self.cuttable:
                low = text.rfind(" ", done, m.start())
                while low > done and not "!" <= text[low - 1] <= "~":
                    low = text.rfind(" ", done, low)
                after = _CUT.search(text, m.end())
                low, end = max(low, done), after.start() if after else end
            if low > done:
                yield text[done:low], True
            yield text[low:end], False
            done = end
        if done < len(text):
            yield text[done:], True

    def length(self, piece: str) -> int:
        """Tokens of one pre-token, by the library's model."""
        return len(self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str, frequent: dict[str, int]) -> int:
        return sum(self._looked_up(part, frequent) if plain else self.whole(part) for part, plain in self.stretches(text))

    def _looked_up(self, text: str, frequent: dict[str, int]) -> int:
        pieces = self.pieces(text)
        known = [frequent.get(p) for p in pieces]
        if None not in known:
            return sum(known)
        cache, total = self.cache, 0
        for piece, n in zip(pieces, known):
            if n is None:
                n = cache.get(piece)
                if n is None:
                    n = self.length(piece)
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[piece] = n
            total += n
        return total


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def frequent_pieces(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens, counted over all texts. At most FREQUENT entries."""

    def summary(batches):
        own = encoder(path)
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part, plain in own.stretches(text):
                    if plain:
                        counts.update(own.pieces(part))
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 4)))
        top = counts.most_common(REPORTED)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    top = (
        docs.select(text_or_empty(text_col).alias("text"))
        .mapInArrow(summary, "piece string, n bigint")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(FREQUENT)
        .select("piece")
    )
    own = encoder(path)
    return {row.piece: own.length(row.piece) for row in top.collect()}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, n_tokens, over_limit.

    ``path`` is the file of a byte-level BPE in the tokenizers library's format. A null text counts as
    empty and has no tokens; strings of special tokens inside a text count as the library counts them.
    A stretch between spaces with such a string, or with a character that the pattern and the library
    class differently, is encoded by the library; the rest of the text is looked up. Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_pieces(docs, path, text_col))

    def count(batches):
        own = encoder(path)
        table = frequent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.fromiter((own.count(t, table) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["_id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, "_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
