"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The best segmentation is the one with the largest sum of piece scores; of equal ones, that whose last
piece is longer, at every place. A character that no piece holds counts as unknown and becomes its
UTF-8 bytes' pieces.

A text falls apart, before any search, wherever two neighbouring characters stand side by side in no
piece: no piece can cross there, so the parts are independent. The parts of many texts then go through
the automaton side by side, one character at a time; equal parts of a step go through it once.
"""

from __future__ import annotations

from collections import deque
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from roamframe.llm.columns import steps, text_or_empty
from roamframe.llm.words import _powers_up_to, mixed

#: Parts that go through the automaton together, and their letters with all as long as the longest.
TOGETHER, CELLS = 16_384, 2_000_000
_BLANK = "▁"
_POINTS = 0x110000
_workers: dict[str, "Pieces"] = {}


class Pieces:
    """A model's pieces as an automaton over the letters that occur in them."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)], dtype=np.float64)
        byte = [i for i in range(size) if model.is_byte(i)]
        self.unknown = model.unk_id()
        self.bytes = np.full(256, self.unknown, dtype=np.int32)
        for i in byte:
            self.bytes[int(texts[i][1:-1], 16)] = i
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and texts[i]]
        self.scores = scores
        self.unknown_score = scores[plain].min() - 10.0
        self._letters([texts[i] for i in plain])
        self._automaton([texts[i] for i in plain], plain, scores)
        # What a piece decodes to.
        kinds = [b"" if model.is_control(i) else t.replace(_BLANK, " ").encode() for i, t in enumerate(texts)]
        for i in byte:
            kinds[i] = bytes([int(texts[i][1:-1], 16)])
        kinds[self.unknown] = " ⁇ ".encode()
        self.out_bytes = np.frombuffer(b"".join(kinds), dtype=np.uint8)
        self.out_first = np.concatenate([[0], np.cumsum([len(k) for k in kinds])]).astype(np.int64)

    def _letters(self, texts: list[str]) -> None:
        """Classes of the letters in pieces (0: in none), and which pairs of classes stand side by side."""
        letters = sorted({c for t in texts if len(t) > 1 for c in t})
        self.classes = len(letters) + 1
        self.class_of = np.zeros(_POINTS, dtype=np.int32)
        self.class_of[[ord(c) for c in letters]] = np.arange(1, self.classes)
        self.joined = np.zeros((self.classes, self.classes), dtype=bool)
        for t in texts:
            for a, b in zip(t, t[1:]):
                self.joined[self.class_of[ord(a)], self.class_of[ord(b)]] = True

    def _automaton(self, texts: list[str], ids: list[int], scores: np.ndarray) -> None:
        children: list[dict[int, int]] = [{}]
        depth, piece = [0], [-1]
        self.single = np.full(_POINTS, -1, dtype=np.int32)
        for text, i in zip(texts, ids):
            if len(text) == 1:
                self.single[ord(text)] = i
                if not self.class_of[ord(text)]:
                    continue
            state = 0
            for c in self.class_of[[ord(c) for c in text]].tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    depth.append(depth[state] + 1)
                    piece.append(-1)
                state = children[state][c]
            piece[state] = i
        n = len(children)
        self.go = np.zeros((n, self.classes), dtype=np.int32)
        fail = [0] * n
        # The next state on the way of failures that ends a piece; 0 ends the way.
        self.link = np.zeros(n, dtype=np.int32)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if state:
                self.go[state] = self.go[fail[state]]
                back = fail[state]
                self.link[state] = back if piece[back] >= 0 else self.link[back]
            for c, child in children[state].items():
                fail[child] = int(self.go[fail[state], c]) if state else 0
                self.go[state, c] = child
                queue.append(child)
        self.depth = np.array(depth, dtype=np.int32)
        self.piece = np.array(piece, dtype=np.int32)
        self.score = np.where(self.piece >= 0, scores[np.maximum(self.piece, 0)], 0.0)

    def _best(self, letters: np.ndarray, first: np.ndarray, size: np.ndarray):
        """(ends, owner): the last state of every piece, or 0 for an unknown letter, part by part."""
        n, longest = len(first), int(size.max())
        column = np.arange(n)
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((longest + 1, n), dtype=np.int32)
        state = np.zeros(n, dtype=np.int32)
        for t in range(longest):
            # Parts come longest first, so those that go on are the first ones.
            live = int(np.searchsorted(-size, -t, side="left"))
            state = self.go[state[:live], letters[first[:live] + t]]
            row, chosen = np.full(live, -np.inf), np.zeros(live, dtype=np.int32)
            at = np.where(self.piece[state] >= 0, state, self.link[state])
            who = np.flatnonzero(at)
            at = at[who]
            single = np.zeros(live, dtype=bool)
            while len(who):
                long = self.depth[at]
                score = best[t + 1 - long, who] + self.score[at]
                better = score > row[who]
                row[who[better]], chosen[who[better]] = score[better], at[better]
                single[who[long == 1]] = True
                at = self.link[at]
                on = np.flatnonzero(at)
                who, at = who[on], at[on]
            lone = np.flatnonzero(~single)
            if len(lone):
                score = best[t, lone] + self.unknown_score
                better = score > row[lone]
                row[lone[better]], chosen[lone[better]] = score[better], 0
            best[t + 1, :live], back[t + 1, :live] = row, chosen
        place, total = size.copy(), best[size, column]
        ends, owners = [], []
        who = column
        while len(who):
            state = back[place[who], who]
            ends.append(state)
            owners.append(who)
            place[who] -= np.where(state > 0, self.depth[state], 1)
            who = who[place[who] > 0]
        return ends, owners, total

    def _part_pieces(self, points: np.ndarray, letters: np.ndarray, first: np.ndarray, size: np.ndarray):
        """(pieces, borders, scores) of distinct parts; an unknown letter is ``-1 - code point``."""
        order = np.argsort(-size, kind="stable")
        out, owner, total = [], [], np.zeros(len(first))
        start = 0
        while start < len(order):
            many = max(1, min(TOGETHER, CELLS // int(size[order[start]])))
            group = order[start : start + many]
            start += many
            ends, owners, total[group] = self._best(letters, first[group], size[group])
            count = np.bincount(np.concatenate(owners), minlength=len(group))
            # Walked from the end: the place of each piece counts down.
            left = np.concatenate([[0], np.cumsum(count)])
            ids = np.empty(left[-1], dtype=np.int32)
            place = left[1:].copy()
            letter_end = first[group] + size[group]
            for state, who in zip(ends, owners):
                place[who] -= 1
                letter_end[who] -= np.where(state > 0, self.depth[state], 1)
                ids[place[who]] = np.where(state > 0, self.piece[state], -1 - points[letter_end[who]].astype(np.int32))
            out.append(ids)
            owner.append(np.repeat(group, count))
        ids, owner = np.concatenate(out), np.concatenate(owner)
        by = np.argsort(owner, kind="stable")
        return ids[by], np.searchsorted(owner[by], np.arange(len(first) + 1)), total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, borders, scores) of the texts."""
        texts = [self.normalize(t) if t else "" for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        own = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(len(texts))
        letters = self.class_of[points]
        cut = np.ones(len(points) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[letters[:-1], letters[1:]]
        cut[own] = True
        edge = np.flatnonzero(cut)
        first, size = edge[:-1], np.diff(edge)
        up, down = _powers_up_to(len(points))
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        prints = mixed((sums[edge[1:]] - sums[first]) * down[first] + size.astype(np.uint64))
        _, sample, which = np.unique(prints, return_index=True, return_inverse=True)
        ids, borders, total = self._part_pieces(points, letters, first[sample], size[sample])
        count = np.diff(borders)[which]
        to = np.concatenate([[0], np.cumsum(count)])
        flat = ids[np.arange(to[-1]) - np.repeat(to[:-1] - borders[:-1][which], count)]
        part_border = np.searchsorted(first, own)
        part_border[-1] = len(first)
        score_sums = np.concatenate([[0.0], np.cumsum(total[which])])
        row_borders = to[part_border]
        # Letters without a place in the automaton: their own piece, or their bytes.
        odd = np.flatnonzero(flat < 0)
        point = -1 - flat[odd]
        flat[odd] = np.where(self.single[point] >= 0, self.single[point], flat[odd])
        extra = np.searchsorted(row_borders, odd, side="right") - 1
        score = score_sums[part_border[1:]] - score_sums[part_border[:-1]]
        held = self.single[point] >= 0
        if held.any():
            np.add.at(score, extra[held], self.scores[self.single[point[held]]] - self.unknown_score)
        odd = odd[~held]
        low = odd[flat[odd] >= -128]
        flat[low] = self.bytes[-1 - flat[low]]
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            coded = [chr(-1 - p).encode() for p in flat[odd].tolist()]
            long = np.array([len(c) for c in coded])
            count = np.ones(len(flat), dtype=np.int64)
            count[odd] = long
            new = np.repeat(flat, count)
            new[new < 0] = self.bytes[np.frombuffer(b"".join(coded), dtype=np.uint8)]
            row_borders = np.concatenate([[0], np.cumsum(count)])[row_borders]
            flat = new
        return flat, row_borders, score

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        """The texts of the ids; the blank that encoding puts first goes again."""
        long = np.diff(self.out_first)[ids]
        to = np.concatenate([[0], np.cumsum(long)])
        data = self.out_bytes[np.arange(to[-1]) - np.repeat(to[:-1] - self.out_first[ids], long)].tobytes()
        edge = to[borders].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:])]


def pieces(path: str) -> Pieces:
    """One per worker process."""
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def _steps(texts: list[str]):
    for a, b in steps([len(t) for t in texts], 1_000_000):
        yield a, b, texts[a:b]


def _same(decoded: list[str], texts: list[str]) -> list[bool]:
    return [x == y.replace(_BLANK, " ") for x, y in zip(decoded, texts)]


def _lists(ids: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids))


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``token_ids`` and ``restored`` in place of any such columns.

    ``restored`` says whether the ids decode to the text again. A null or empty text has no tokens. Rows
    stay as they are, repeated ones too.
    """
    added = ["n_tokens", "token_ids", "restored"]
    kept = [c for c in docs.columns if c not in (text_col, *added)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(text_col).alias(text_col))
    schema = rows.drop(text_col).schema.add("n_tokens", "long").add("token_ids", ArrayType(IntegerType())).add("restored", "boolean")

    def encode(batches):
        own = pieces(path)
        for batch in batches:
            for a, b, texts in _steps(batch.column(len(kept)).to_pylist()):
                ids, borders, _ = own.encode(texts)
                same = _same(own.decode(ids, borders), texts)
                columns = [c.slice(a, b - a) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(borders)), _lists(ids, borders), pa.array(same)], [*kept, *added])

    return rows.mapInArrow(encode, schema)


def decode_documents(docs: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``docs`` with the ids decoded into ``text_col``; null ids give an empty text."""
    kept = [c for c in docs.columns if c != text_col]
    at = kept.index(ids_col)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(text_col, "string")

    def decode(batches):
        own = pieces(path)
        for batch in batches:
            ids = batch.column(at).fill_null([])
            borders = ids.offsets.to_numpy().astype(np.int64)
            texts = own.decode(ids.values.to_numpy(zero_copy_only=False)[borders[0] : borders[-1]], borders - borders[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text_col])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(decode, schema)


def piece_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_chars, n_tokens, n_byte_tokens, score, ids_sha256, restored.

    Every whole text is encoded, and its ids decoded again; ``restored`` says whether that gave the text
    (a text that itself holds the model's sign for a blank gets blanks there). ids_sha256 is over the
    ids as little-endian 32-bit integers. A null text counts as empty, has no tokens and score 0. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    names = ["_id", "n_chars", "n_tokens", "n_byte_tokens", "score", "ids_sha256", "restored"]

    def check(batches):
        own = pieces(path)
        fallback = np.zeros(len(own.out_first), dtype=np.int64)
        fallback[own.bytes[own.bytes != own.unknown]] = 1
        for batch in batches:
            for a, b, texts in _steps(batch.column(1).to_pylist()):
                ids, borders, score = own.encode(texts)
                again = own.decode(ids, borders)
                sums = np.concatenate([[0], np.cumsum(fallback[ids])])
                prints = [sha256(ids[i:j].astype("<i4").tobytes()).hexdigest() for i, j in zip(borders, borders[1:])]
                same = _same(again, texts)
                own_rows = [batch.column(0).slice(a, b - a), *map(pa.array, ([len(t) for t in texts], np.diff(borders), sums[borders[1:]] - sums[borders[:-1]], score, prints, same))]
                yield pa.RecordBatch.from_arrays(own_rows, names)

    out = rows.mapInArrow(check, "_id bigint, n_chars bigint, n_tokens bigint, n_byte_tokens bigint, score double, ids_sha256 string, restored boolean")
    return out.withColumnRenamed("_id", id_col)
