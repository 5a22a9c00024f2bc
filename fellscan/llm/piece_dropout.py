"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model's BPE is followed as published: characters, then an agenda of neighbouring pairs that are in the vocabulary,
best score first and leftmost among equals. With dropout each candidate taken from the agenda is skipped at the rate. The
skips hang on the seed, the document (id and text), its copy number, the word's place in the text and the candidate's turn,
so every occurrence of a word is segmented anew, yet the same seed gives the same ids on any cluster. Rows of equal id and
text are copies of one document, numbered from 0; they differ in nothing but their segmentation.

How many candidates pass between two skips is geometric, so one hash gives the turn of a word's next skip. An occurrence
whose first skip would come after the word's last merge has the undropped ids, which workers remember; all other ones run
an agenda of their own. Agendas of words of one length run side by side, a step taking the best pair of each. Long words
are not remembered. No vocabulary piece holds a blank after another character nor a line feed (checked when the model is
loaded), so words may be encoded one by one.

Decoding joins the pieces' bytes and takes the leading blank away that encoding put there; it is lossless for every text,
with any rate. A literal U+2581, which the library itself would return as a blank, is written in bytes for that.

Null text counts as empty and gives no ids. A map over the rows without a shuffle where all doc_ids differ, which is looked
up first; else rows are dealt by id and text to number the copies, and a group is one document's equal rows. Memory of one
batch and bounded tables; very long texts cost in proportion. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import gc
import math
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import count, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

SEED, DROPOUT = 20_240_229, 0.1
#: Speed only: words remembered, the longest that is, words whose agendas run at once, and characters of texts at once.
REMEMBERED, LONG, _ROWS, _CHARACTERS = 250_000, 40, 50_000, 1_000_000
_MASK, _PLACE, _TURN = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_NEVER, _CHUNK = 1 << 30, re.compile(" *[^ ]+| +")
_models: dict = {}


class Model:
    """Pieces of a model with blanks in place of U+2581."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.costs, self.bytes, self.byte_ids = {}, [], [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.costs.append(-sp.get_score(i))
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                piece = piece.replace("\u2581", " ")
                if "\n" in piece or " " in piece.lstrip(" "):
                    raise ValueError(f"words are not independent in this model: piece {piece!r}")
                self.ids[piece] = i
                self.bytes.append(piece.encode())

    def word(self, word: str, gaps: Iterable[int]) -> tuple[list[int], int]:
        """Ids of a word by agenda, and how many candidates came after the last skip.

        ``gaps`` says how many candidates are taken before each skip, without end. A symbol is known by where it starts;
        end[i] is where it ends, 0 once it has merged into the one before.
        """
        get, cost, n, gaps = self.ids.get, self.costs, len(word), iter(gaps)
        left, since = next(gaps), 0
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, i + 1, i + 2, p) for i in range(n - 1) if (p := get(word[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, middle, e, p = heappop(agenda)
            if end[i] != middle or end[middle] != e:
                continue  # one of the two has merged meanwhile
            if since == left:
                left, since = next(gaps), 0
                continue
            since += 1
            end[i], end[middle] = e, 0
            if e < n:
                before[e] = i
                if (q := get(word[i : end[e]])) is not None:
                    heappush(agenda, (cost[q], i, e, end[e], q))
            if (h := before[i]) >= 0 and (q := get(word[h:e])) is not None:
                heappush(agenda, (cost[q], h, i, e, q))
        out, i = [], 0
        while i < n:
            e = end[i]
            if (p := get(word[i:e])) is not None:
                out.append(p)
            else:
                out.extend(map(self.byte_ids.__getitem__, word[i:e].encode("utf-8", "surrogatepass")))
            i = e
        return out, since

    def packed(self, word: str, gaps: Iterable[int]) -> bytes:
        ids, _ = self.word(word, gaps)
        return struct.pack(f"<{len(ids)}i", *ids)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each code point (-1: none), and the pairs of symbols that make a piece, as sorted keys, piece and cost rank."""
        symbols = np.full(0x110000, -1, np.int32)
        pairs = {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                symbols[ord(piece)] = i
            for k in range(1, len(piece)):
                if (x := self.ids.get(piece[:k])) is not None and (y := self.ids.get(piece[k:])) is not None:
                    pairs[x * len(self.costs) + y] = i
        keys = np.array(sorted(pairs), np.int64)
        made = np.array([pairs[k] for k in keys.tolist()], np.int32)
        ranks = np.unique(np.array(self.costs), return_inverse=True)[1].astype(np.int32)  # equal costs share a rank
        return symbols, keys, made, ranks


_DONE = np.iinfo(np.int32).max


class Agendas:
    """The agendas of many words at once: each step takes every word's best pair, the leftmost of equals."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.costs)
        self.symbols, self.keys, self.made, self.ranks = model.tables()

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of pairs of symbols; rank _DONE where they make no piece."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        made = np.where(there, self.made[at], 0)
        return made, np.where(there, self.ranks[made], _DONE)

    def run(self, words: list[str], gap_at=None) -> tuple[list[bytes], np.ndarray]:
        """Ids of words as bytes, and how many merges were done. ``gap_at(rows, turn)`` says how many candidates of these words
        are taken before the skip of that turn; without it nothing is skipped."""
        out, merges = [b""] * len(words), np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
            for k in range(0, len(some), _ROWS):
                self._equal_lengths(words, some[k : k + _ROWS], gap_at, out, merges)
        return out, merges

    def _equal_lengths(self, words: list[str], rows: np.ndarray, gap_at, out: list[bytes], merges: np.ndarray) -> None:
        points = np.frombuffer("".join([words[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
        seq = self.symbols[points].reshape(len(rows), -1)
        if (unknown := (seq < 0).any(1)).any():  # bytes stand for such characters: the words go one by one
            for i in rows[unknown].tolist():
                ids, n = self.model.word(words[i], repeat(_NEVER) if gap_at is None else (int(gap_at(np.array([i]), t)[0]) for t in count()))
                out[i], merges[i] = struct.pack(f"<{len(ids)}i", *ids), n
            rows, seq = rows[~unknown], seq[~unknown]
        n, width = seq.shape
        w = width + 1  # the last column stands for the place before the first and after the last symbol
        shape = lambda fill: np.full((n, w), fill, np.int32)
        symbol, made, rank = shape(-1), shape(0), shape(_DONE)
        symbol[:, :width] = seq
        made[:, : width - 1], rank[:, : width - 1] = self._pairs(seq[:, :-1], seq[:, 1:])
        after, before = shape(0) + np.arange(1, w + 1, dtype=np.int32), shape(0) + np.arange(-1, width, dtype=np.int32)
        after[:, width], before[:, 0] = width, width
        alive = np.ones((n, width), bool)
        s_flat, m_flat, r_flat, a_flat, b_flat = (v.ravel() for v in (symbol, made, rank, after, before))
        live, turn = np.arange(n), np.zeros(n, np.int64)
        left = np.full(n, _NEVER) if gap_at is None else np.array(gap_at(rows, turn))
        while len(live):
            now = rank[live]
            best = now.argmin(1)
            going = now[np.arange(len(live)), best] != _DONE
            live, best = live[going], best[going]
            skip = left[live] == 0
            if skip.any():
                some = live[skip]
                r_flat[some * w + best[skip]] = _DONE
                turn[some] += 1
                left[some] = gap_at(rows[some], turn[some])
                at, i = live[~skip], best[~skip]
            else:
                at, i = live, best
            left[at] -= 1
            at_row, here = at * w, at * w + i
            j = a_flat[here]
            k, h = a_flat[at_row + j], b_flat[here]
            s_flat[here] = m_flat[here]
            alive[at, j] = False
            r_flat[at_row + j] = _DONE
            a_flat[here], b_flat[at_row + k] = k, i
            pair = np.r_[at_row + h, here]
            m_flat[pair], r_flat[pair] = self._pairs(s_flat[pair], np.r_[s_flat[here], s_flat[at_row + k]])
        size = alive.sum(1)
        data, ends = symbol[:, :width][alive].astype("<i4").tobytes(), (4 * np.cumsum(size)).tolist()
        for i, a, b in zip(rows.tolist(), [0, *ends], ends):
            out[i] = data[a:b]
        merges[rows] = width - size


class _Words:
    """Words seen so far: the number of each, and by number its text, whether it is led by a blank, ids and merges where nothing is skipped."""

    def __init__(self, agendas: Agendas):
        self.agendas = agendas
        self.clear()

    def clear(self) -> None:
        # a word after a blank, and one as it stands
        self.numbers = {" ": {}, "": {}}
        self.words, self.led, self.ids, self.merges = [], bytearray(), [], np.zeros(0, np.int32)

    def learn(self, lead: str, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.numbers[lead]]
        if not new:
            return
        self.numbers[lead].update(zip(new, range(len(self.words), len(self.words) + len(new))))
        spelled = [lead + w for w in new] if lead else new
        ids, merges = self.agendas.run([w if len(w) <= LONG else "" for w in spelled])
        # long words are not worked out here: each occurrence goes through its own agenda
        merges[[k for k, w in enumerate(spelled) if len(w) > LONG]] = _NEVER
        self.words += new
        self.led += bytes([bool(lead)]) * len(new)
        self.ids += ids
        self.merges = np.r_[self.merges, np.minimum(merges, _NEVER).astype(np.int32)]


def _mixed(x: int) -> int:
    """splitmix64's last steps; _mixed_all is the same on arrays."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Encoder:
    def __init__(self, path: str, seed: int, rate: float, remembered: int = REMEMBERED):
        gc.set_threshold(100_000, 50, 50)  # tables of strings form no cycles; looking through them often is waste
        if path not in _models:
            _models[path] = Agendas(Model(path))
        self.agendas = _models[path]
        self.model = self.agendas.model
        self.salt, self.rate, self.remembered = xxh3_64_intdigest(f"{seed}"), rate, remembered
        self.words = _Words(self.agendas)
        self.line_feed = np.array([self.model.byte_ids[10]], "<i4").tobytes()
        # limits[g]: a hash below it, as a share of all, means that at most g candidates come before the skip
        self.limits = np.array([]) if rate <= 0 else np.array([1.0]) if rate >= 1 else 1.0 - (1.0 - rate) ** np.arange(1, 2 + math.ceil(-37 / math.log1p(-rate)))
        self.limit_list = self.limits.tolist()

    def _gaps(self, starts: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """How many candidates come before the skip of each turn; _later gives the same, one by one."""
        if not self.rate:
            return np.full(len(starts), _NEVER)
        mixed = _mixed_all(starts + turns.astype(np.uint64) * np.uint64(_TURN))
        return np.searchsorted(self.limits, (mixed >> np.uint64(11)) * 2.0**-53, side="right")

    def _later(self, key: int, place: int) -> Iterator[int]:
        """How many candidates come before each skip of the word at a place, without end."""
        start, turn = _mixed((key ^ self.salt) + place * _PLACE & _MASK), 0
        while True:
            yield bisect_right(self.limit_list, (_mixed(start + turn * _TURN & _MASK) >> 11) * 2.0**-53) if self.rate else _NEVER
            turn += 1

    def encode(self, text: str, key: int) -> bytes:
        return self.encode_all([text], [key])[0]

    def encode_all(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; a key is the hash that a document's skips hang on."""
        out, a = [], 0
        while a < len(texts):  # runs of about a million characters
            b, n = a, 0
            while b < len(texts) and n < _CHARACTERS:
                n += len(texts[b])
                b += 1
            out += self._run(texts[a:b], keys[a:b])
            a = b
        return out

    def _run(self, texts: list[str], keys: list[int]) -> list[bytes]:
        if len(self.words.words) > self.remembered:
            self.words.clear()
        lines = []  # of each text: lists of words, and whether a blank stands before them
        for text in texts:
            mine = []
            for line in (" " + text).split("\n") if text else []:
                if "  " in line or line.endswith(" "):
                    mine.append((_CHUNK.findall(line), ""))
                else:
                    first, *rest = line.split(" ")
                    mine += [([first], ""), (rest, " ")] if first else [(rest, " ")]
                mine.append(None)
            lines.append(mine)
        for lead in (" ", ""):
            self.words.learn(lead, set().union(*[some[0] for mine in lines for some in mine if some and some[1] == lead]))
        numbers, parts, n_words = [], [], []
        for mine in lines:
            before, own = len(numbers), []
            for some in mine:
                if some is None:
                    own.append(len(numbers))
                else:
                    numbers += map(self.words.numbers[some[1]].__getitem__, some[0])
            parts.append((before, own))
            n_words.append(len(numbers) - before)
        u = np.array(numbers, np.int64)
        base = np.repeat(np.array([(k ^ self.salt) & _MASK for k in keys], np.uint64), n_words)
        place = np.arange(len(u)) - np.repeat(np.cumsum([0, *n_words])[:-1], n_words)
        starts = _mixed_all(base + place.astype(np.uint64) * np.uint64(_PLACE))
        hit = np.flatnonzero(self._gaps(starts, np.zeros(len(u), np.int64)) < self.words.merges[u]) if self.rate else np.flatnonzero(self.words.merges[u] == _NEVER)
        ids = list(map(self.words.ids.__getitem__, numbers))
        if len(hit):
            words = [" " + self.words.words[k] if self.words.led[k] else self.words.words[k] for k in u[hit].tolist()]
            some = starts[hit]
            for j, data in zip(hit.tolist(), self.agendas.run(words, lambda rows, turn: self._gaps(some[rows], np.broadcast_to(np.asarray(turn), rows.shape)))[0]):
                ids[j] = data
        out = []
        for before, own in parts:
            whole = []
            for end in own:
                whole += ids[before:end]
                whole.append(self.line_feed)
                before = end
            out.append(b"".join(whole[:-1]))
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.model.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


_encoders: dict = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def by_characters(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in runs of about a million characters, one row at least: ids are handed on before the next run is encoded."""
    for pdf in batches:
        ends = np.cumsum(pdf["text"].str.len().to_numpy(np.int64))
        a = 0
        while a < len(pdf):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CHARACTERS, "right")))
            yield pdf.iloc[a:b].reset_index(drop=True)
            a = b


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and the number of each row among the rows of equal id and text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.withColumn("copy", F.lit(0))
    # two hashes and the length stand for the text; rows of one group cannot be told apart, so their order is all the same
    same = Window.partitionBy("doc_id", "low", "high", "length").orderBy("length")
    told = rows.withColumns({"low": F.xxhash64("text"), "high": F.xxhash64(F.lit(1), "text"), "length": F.length("text")})
    return told.withColumn("copy", F.row_number().over(same) - 1).drop("low", "high", "length")


def encode(docs: DataFrame, path: str, seed: int = SEED, rate: float = DROPOUT, keep_ids: bool = True) -> DataFrame:
    """doc_id, copy, n_pieces, ids_crc32, lossless (the ids were decoded and gave the text), and the ids themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _encoder(path, seed, rate)
        for pdf in by_characters(batches):
            done = coder.encode_all(pdf["text"].tolist(), pdf["key"].tolist())
            out = {"doc_id": pdf["doc_id"], "copy": pdf["copy"], "n_pieces": [len(d) // 4 for d in done], "ids_crc32": [zlib.crc32(d) for d in done], "lossless": [coder.decode(d) == t for d, t in zip(done, pdf["text"])]}
            yield pd.DataFrame(out | ({"ids": [np.frombuffer(d, "<i4") for d in done]} if keep_ids else {}))

    return numbered(docs).withColumn("key", F.xxhash64("doc_id", "text", "copy")).mapInPandas(run, f"doc_id {kind}, copy int, n_pieces bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * keep_ids)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give a null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _encoder(path, SEED, 0.0)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if x is None else coder.decode(np.asarray(x, "<i4").tobytes()) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")
