"""Encoding and decoding with a merge-type piece vocabulary, with seeded merge dropout.

Adjacent symbols merge by an agenda: the best-scored piece first, the leftmost of equal ones. A candidate
merge is skipped if a hash keyed by the seed, the document, the word's turn in it, the place and the piece falls below the
dropout rate. So each occurrence of a word has its own draws, the same seed always gives the same ones, and all
segmentations decode to the text. No occurrence shares a segmentation with another and nothing is kept from one group of texts to the next. Without dropout the ids are those of the vocabulary's own encoder (but a literal U+2581 becomes bytes).
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.llm.words import mix, tidy

VOCABULARY = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
_SPACE = "▁"
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Chunks up to this length go through the agenda side by side, longer ones one by one.
_SIDE_BY_SIDE = 48
_PLACE_BITS = 6
_NONE = np.iinfo(np.int32).max
#: What is left where a symbol was merged into the one before it.
_GONE = np.iinfo(np.int32).min
#: Characters of the texts that are segmented together, and chunks that go through the agenda at once.
_GROUP = 1 << 20
_AT_ONCE = 1 << 14
_TURN = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << 64) - 1


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return mix(place.astype(np.uint64) * _TURN + piece.astype(np.uint64))


def _mix(x: int) -> int:
    """``words.mix`` of one number."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _WORD
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _WORD
    return x ^ (x >> 33)


class PieceCoder:
    def __init__(self, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED):
        model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
        self.dropout, self.seed = dropout, seed
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.raw = [b""] * n
        for i in normal:
            self.raw[i] = pieces[i].replace(_SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.raw[i] = bytes([b])
        # symbols are pieces, and single characters of pieces that are none themselves
        self.symbols = {pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in pieces[i]} - set(self.symbols)):
            self.symbols[c] = n + len(self.symbols)
        self.names = {v: k for k, v in self.symbols.items()}
        #: symbol of each code point, those without one as negative numbers
        self.of_char = -np.arange(0x110000, dtype=np.int32) - 1
        for c, symbol in self.symbols.items():
            if len(c) == 1 and c != _SPACE:
                self.of_char[ord(c)] = symbol
        self.of_char[32] = self.symbols[_SPACE]
        self.size = n
        self.base = max(self.symbols.values()) + 2
        pairs: dict[int, int] = {}
        for i in normal:
            for cut in range(1, len(pieces[i])):
                left, right = self.symbols.get(pieces[i][:cut]), self.symbols.get(pieces[i][cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = i
        self.pairs = pairs
        self._hash(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        levels = {score: k for k, score in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        self.rank = np.zeros(n, np.int32)
        self.rank[normal] = [levels[model.get_score(i)] for i in normal]
        # the space stands at the start of pieces only, so chunks never merge with what precedes them
        if any(_SPACE in pieces[i].lstrip(_SPACE) or "\n" in pieces[i] for i in normal):
            raise ValueError("the vocabulary has pieces that reach across spaces or lines")
        # nor do signs that follow a letter in no piece merge with the word before them
        pairs_seen = {p[k : k + 2] for p in (pieces[i] for i in normal) for k in range(len(p) - 1)}
        letter = re.compile(f"[{_LETTERS}]")
        apart = "".join(re.escape(c) for c in string.punctuation if not any(p[1] == c and letter.match(p[0]) for p in pairs_seen))
        begun = f" *[^ \n{apart}]*[{_LETTERS}](?=[{apart}])|" if apart else ""
        self.chunks = re.compile(f"{begun} +[^ \n]*|\n|[^ \n]+")
        self.whole = np.uint64(min(int(dropout * 2**64), 2**64 - 1))

    def start(self, text: str) -> np.ndarray:
        """Symbols of the characters of a text; those unknown get negative code points."""
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _hash(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """A table of the pairs with few collisions: a pair stands in its slot or in one of the next."""
        bits = max(8, int(len(keys) * 8).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_keys, self.slot_ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_keys[at] < 0
            first = np.unique(np.where(free, at, -1), return_index=True)[1]
            first = first[free[first]]
            self.slot_keys[at[first]], self.slot_ids[at[first]] = keys[first], ids[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ids, at = keys[left], ids[left], (at[left] + 1) & self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _TURN) >> self.shift).astype(np.int64)

    def _pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of each pair in the vocabulary, -1 for none."""
        want = left.astype(np.int64) * self.base + right
        want[(left < 0) | (right < 0)] = -2
        at = self._slot(want)
        there = self.slot_keys[at]
        found = np.where(there == want, self.slot_ids[at], np.int32(-1))
        look = np.flatnonzero((there != want) & (there >= 0))
        while len(look):
            at[look] = (at[look] + 1) & self.slots
            there = self.slot_keys[at[look]]
            met = there == want[look]
            found[look[met]] = self.slot_ids[at[look[met]]]
            look = look[~met & (there >= 0)]
        return found

    def _offers(self, left: np.ndarray, right: np.ndarray, keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of pairs and their order on the agenda; pairs in no piece, and those skipped by their hash, have none."""
        found = self._pieces(left, right)
        has = np.flatnonzero(found >= 0)
        if self.dropout:
            has = has[mix(keys[has] ^ _mixed(place[has], found[has])) >= self.whole]
        order = np.full(len(found), _NONE, np.int32)
        order[has] = self.rank[found[has]] << _PLACE_BITS | place[has]
        return found, order

    def _side_by_side(self, symbols: np.ndarray, starts: np.ndarray, width: int, keys: np.ndarray) -> None:
        """The agenda of chunks of one width, a column each: every round takes the top of each column's agenda. Changes ``symbols``."""
        n = len(starts)
        places = np.arange(width, dtype=np.int32)[:, None]
        where = starts + places
        rows = symbols[where]
        piece, order = np.full((width, n), -1, np.int32), np.full((width, n), _NONE, np.int32)
        first = np.broadcast_to(places[:-1], (width - 1, n)).ravel()
        found = self._offers(rows[:-1].ravel(), rows[1:].ravel(), np.broadcast_to(keys, (width - 1, n)).ravel(), first)
        piece[:-1], order[:-1] = (x.reshape(width - 1, n) for x in found)
        after, before = np.repeat(places + 1, n, 1), np.repeat(places - 1, n, 1)
        while True:
            best = order.min(0)
            live = np.flatnonzero(best < _NONE)
            if len(live) < 0.75 * n:
                symbols[where] = rows
                if not len(live):
                    return
                where, rows, piece, order, after, before = (np.ascontiguousarray(x[:, live]) for x in (where, rows, piece, order, after, before))
                keys, best, n = keys[live], best[live], len(live)
                live = np.arange(n)
            else:
                best = best[live]
            flat_rows, flat_piece, flat_order, flat_after, flat_before = (x.reshape(-1) for x in (rows, piece, order, after, before))
            place = best & (1 << _PLACE_BITS) - 1
            at = place * n + live
            gone = flat_after[at] * n + live
            flat_rows[at] = flat_piece[at]
            flat_rows[gone], flat_order[gone], flat_order[at] = _GONE, _NONE, _NONE
            follows = flat_after[gone]
            flat_after[at] = follows
            right = np.flatnonzero(follows < width)
            flat_before[follows[right] * n + live[right]] = place[right]
            left = np.flatnonzero(flat_before[at] >= 0)
            beside = flat_before[at[left]] * n + live[left]
            one = np.concatenate((at[right], beside))
            other = np.concatenate((follows[right] * n + live[right], at[left]))
            column = np.concatenate((live[right], live[left]))
            flat_piece[one], flat_order[one] = self._offers(flat_rows[one], flat_rows[other], keys[column], one // n)

    def _alone(self, symbols: np.ndarray, key: int) -> None:
        """The agenda of one long chunk. Changes ``symbols``."""
        own = symbols.tolist()
        n = len(own)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []
        whole = int(self.whole)

        def offer(i: int, j: int) -> None:
            if own[i] >= 0 and own[j] >= 0:
                m = self.pairs.get(own[i] * self.base + own[j])
                if m is not None and not (whole and _mix(key ^ _mix((i * int(_TURN) + m) & _WORD)) < whole):
                    heapq.heappush(agenda, (int(self.rank[m]), i, j, m))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, m = heapq.heappop(agenda)
            if own[i] == _GONE or after[i] != j or self.pairs.get(own[i] * self.base + own[j]) != m:
                continue
            own[i], own[j] = m, _GONE
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        symbols[:] = own

    def _bytes(self, symbol: int) -> np.ndarray:
        """Ids of the bytes of a character that is no piece."""
        return self.byte_ids[list((chr(-symbol - 1) if symbol < 0 else self.names[symbol]).encode("utf-8", "surrogatepass"))]

    def encode(self, texts: list[str], draws: np.ndarray) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; ``draws`` is a 64-bit number for each text."""
        spaced = [" " + t if t else "" for t in texts]
        lengths = [list(map(len, self.chunks.findall(t))) for t in spaced]
        counts = np.array(list(map(len, lengths)), np.int64)
        sizes = np.array([n for own in lengths for n in own], np.int64)
        starts = np.cumsum(sizes) - sizes
        turn = np.arange(len(sizes), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
        keys = mix((np.repeat(draws, counts) ^ mix(np.array([self.seed + 1], np.uint64))) + turn * _TURN)
        symbols = self.start("".join(spaced))
        by_size = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[by_size], np.arange(2, _SIDE_BY_SIDE + 2))
        for width, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 2):
            for at in range(a, b, _AT_ONCE):
                part = by_size[at : min(at + _AT_ONCE, b)]
                self._side_by_side(symbols, starts[part], width, keys[part])
        for i in by_size[cuts[-1] :].tolist():
            self._alone(symbols[starts[i] : starts[i] + sizes[i]], int(keys[i]))
        here = symbols != _GONE
        ends = np.concatenate(([0], np.cumsum(here)))[np.cumsum([0, *map(len, spaced)])]
        ids = symbols[here].astype("<i4")
        odd = np.flatnonzero((ids < 0) | (ids >= self.size))
        if len(odd):
            spelled = [self._bytes(x) for x in ids[odd].tolist()]
            wide = np.ones(len(ids), np.int64)
            wide[odd] = list(map(len, spelled))
            to = np.concatenate(([0], np.cumsum(wide)))
            out = np.repeat(ids, wide)
            for i, x in zip(to[odd].tolist(), spelled, strict=True):
                out[i : i + len(x)] = x
            ids, ends = out, to[ends]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in itertools.pairwise((4 * ends).tolist())]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


@lru_cache(4)
def shared_coder(path: str | None, dropout: float, seed: int) -> PieceCoder:
    """The coder of this worker process, for all its tasks."""
    return PieceCoder(path, dropout, seed)


def _segmented(batches, coder: PieceCoder):
    """Groups of rows of each batch with the ids of their texts."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        draws = batch.column("draw").to_numpy().view(np.uint64)
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _GROUP):
                size += len(texts[stop])
                stop += 1
            yield batch.slice(at, stop - at), texts[at:stop], coder.encode(texts[at:stop], draws[at:stop])
            at = stop


def _encoded(path, dropout, seed):
    @tidy
    def run(batches):
        for rows, _, ids in _segmented(batches, shared_coder(path, dropout, seed)):
            cuts = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), lists], names=["doc_id", "text", "ids"])

    return run


def _with_draws(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)).alias("draw"))


def encode_documents(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``doc_id, text, ids`` for every row and whole text of ``docs``; null and empty texts have no ids.

    The segmentation depends on ``seed``, the ``doc_id`` and the word's turn in the text, not on the layout of the table.
    """
    return _with_draws(docs, seed).mapInArrow(_encoded(path, dropout, seed), "doc_id long, text string, ids array<int>")


def _decoded(path):
    @tidy
    def run(batches):
        coder = shared_coder(path, 0.0, SEED)
        for batch in batches:
            ids = batch.column("ids")
            values, cuts = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])
            parts = [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text")), pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array([coder.decode(x) for x in parts], pa.string())],
                names=["doc_id", "text", "n_ids", "ids_crc32", "decoded"],
            )

    return run


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text, n_ids, ids_crc32, decoded`` for rows of ``encode_documents``; the checksum is that of little-endian 32-bit ids."""
    return encoded.mapInArrow(_decoded(path), "doc_id long, text string, n_ids long, ids_crc32 long, decoded string")


def _round_trip(path, dropout, seed):
    @tidy
    def run(batches):
        coder = shared_coder(path, dropout, seed)
        for rows, texts, ids in _segmented(batches, coder):
            decoded = [coder.decode(x) for x in ids]
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(digests), pa.array([a == b for a, b in zip(decoded, texts, strict=True)])]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"])

    return run


def round_trips(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_sha256, lossless``: texts encoded, decoded and compared in one step.

    The same ids and texts as those of ``encode_documents`` and ``decode_documents``, for every row of ``docs``.
    """
    return _with_draws(docs, seed).mapInArrow(_round_trip(path, dropout, seed), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")
