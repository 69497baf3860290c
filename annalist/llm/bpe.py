"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation uses no regular expression. Every code point has a class; looking one or
two code points ahead gives apostrophes that begin a contraction and white space that ends
its run classes of their own. Reading a class is a function on eight states. All
compositions of these functions form a small monoid, so a composition is one look-up in
its multiplication table and, being associative, can be scanned in blocks: products within
all blocks side by side, then over the blocks' totals, then both combined.
"""

import hashlib
import heapq
import itertools
import unicodedata
from base64 import b64decode

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import once_per_process, record_batch, small_batches

# classes of code points
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, BLANK, GAP, STOP = range(9)
# STOP: between two texts; SHORT, LONG: apostrophe of a contraction with one or two letters; SPACES: white space before
# white space or the end; BLANK: a space, GAP: other white space, before something else

#: White space of the pattern's \s, the letters of its contractions
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

# states: what the code points read so far leave open
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_BLANK, NEED_ONE, NEED_TWO, CLOSED = range(8)

#: stands between texts, beyond all code points
STOP_CODE = 0x110000
#: slices kept in a worker's cache, and the longest one that is kept
CACHE_SLICES, CACHE_LENGTH = 400_000, 64
#: code points of a block, and of a part that is scanned at once; ids that are decoded at once
BLOCK, PART, DECODED = 256, 1 << 20, 1 << 16


def read_class(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at this code point."""
    if kind == STOP:
        return CLOSED, True
    if state in (NEED_ONE, NEED_TWO):
        return (CLOSED if state == NEED_ONE else NEED_ONE), False
    if kind == SPACES:
        return IN_SPACES, state != IN_SPACES
    if kind == BLANK:
        return AFTER_BLANK, True
    if kind == GAP:
        return CLOSED, True
    joined = state == AFTER_BLANK
    if kind == LETTER:
        return IN_LETTERS, not (joined or state == IN_LETTERS)
    if kind == NUMBER:
        return IN_NUMBERS, not (joined or state == IN_NUMBERS)
    if joined or state == IN_OTHERS:
        return IN_OTHERS, False
    return {OTHER: IN_OTHERS, SHORT: NEED_ONE, LONG: NEED_TWO}[kind], True


def transition_monoid():
    """Closure of the classes' functions under composition: (id of each class, product, image of CLOSED)."""
    functions = [tuple(read_class(s, k)[0] for s in range(8)) for k in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys(functions))}
    known.setdefault(tuple(range(8)), len(known))
    queue = list(known)
    for f in queue:  # grows while it is read
        for g in functions:
            both = tuple(g[f[s]] for s in range(8))
            if both not in known:
                known[both] = len(known)
                queue.append(both)
    elements = list(known)
    product = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in elements] for f in elements], np.uint16)
    return np.array([known[f] for f in functions], np.uint16), product.ravel(), len(elements), elements, known


class Scanner:
    """Starts of slices in many texts at once."""

    def __init__(self):
        kinds = np.full(STOP_CODE + 1, OTHER, np.uint8)
        for code in range(STOP_CODE):
            general = unicodedata.category(chr(code))[0]
            if general == "L":
                kinds[code] = LETTER
            elif general == "N":
                kinds[code] = NUMBER
        kinds[list(WHITE_SPACE)] = SPACES
        kinds[STOP_CODE] = STOP
        self.kinds = kinds
        self.element, self.product, self.size, elements, known = transition_monoid()
        self.identity = known[tuple(range(8))]
        self.images = np.array([[f[s] for f in elements] for s in range(8)], np.uint8)
        self.starts = np.array([[read_class(s, k)[1] for k in range(9)] for s in range(8)]).ravel()

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Classes of code points that end with STOP_CODE."""
        kinds = self.kinds[codes]
        white = kinds == SPACES
        ends = np.flatnonzero(white[:-1] & ~white[1:] & (kinds[1:] != STOP))
        quotes = np.flatnonzero(codes == ord("'"))
        kinds[ends] = np.where(codes[ends] == 32, BLANK, GAP)
        if len(quotes):
            first = codes[quotes + 1]
            second = codes[np.minimum(quotes + 2, len(codes) - 1)]
            long = np.zeros(len(quotes), bool)
            for a, b in TWO_LETTERS:
                long |= (first == ord(a)) & (second == ord(b))
            kinds[quotes[long]] = LONG
            kinds[quotes[np.isin(first, [ord(c) for c in ONE_LETTER])]] = SHORT
        return kinds

    def scan(self, kinds: np.ndarray, state: int = CLOSED) -> np.ndarray:
        """States before and after every position: scan of the functions, applied to the state."""
        n, size = len(kinds), self.size
        blocks = -(-n // BLOCK)
        cells = np.full(blocks * BLOCK, self.identity, np.uint16)
        cells[:n] = self.element[kinds]
        cells = np.ascontiguousarray(cells.reshape(blocks, BLOCK).T)
        for k in range(1, BLOCK):
            cells[k] = self.product[cells[k - 1].astype(np.intp) * size + cells[k]]
        totals, step = cells[-1].copy(), 1
        while step < blocks:
            totals[step:] = self.product[totals[:-step].astype(np.intp) * size + totals[step:]]
            step *= 2
        before = np.concatenate([[self.identity], totals[:-1]]).astype(np.intp)
        after = self.images[state][self.product[before[None, :] * size + cells]].T.ravel()[:n]
        return np.concatenate([np.array([state], np.uint8), after])

    def slice_starts(self, kinds: np.ndarray) -> np.ndarray:
        """Where slices start, part by part, so that very long texts take bounded memory."""
        found, state = [], CLOSED
        for at in range(0, len(kinds), PART):
            part = kinds[at : at + PART]
            states = self.scan(part, state)
            state = int(states[-1])
            found.append(at + np.flatnonzero(self.starts[states[:-1] * np.uint8(9) + part]))
        return np.concatenate(found)

    def slices(self, texts: list[str]) -> list[list[str]]:
        """Every text's slices."""
        joined = "\0".join([*texts, ""])
        if not texts:
            return []
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[stops] = STOP_CODE
        starts = self.slice_starts(self.classes(codes))
        ends = np.searchsorted(starts, stops).tolist()
        bounds = starts.tolist()
        cut = [joined[a:b] for a, b in itertools.pairwise(bounds)]
        return [cut[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]


class Merger(dict):
    """Slice -> its ids as little-endian 32-bit integers; merged when first met."""

    def __init__(self, ranks: dict):
        super().__init__()
        self.ranks = ranks
        self.pairs = {}

    def __missing__(self, text: str) -> bytes:
        ids = np.array(self.merge(text.encode()), "<u4").tobytes()
        if len(text) <= CACHE_LENGTH:
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[text] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Joins the pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > CACHE_LENGTH:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b) for a, b in itertools.pairwise(parts)]
        none = 1 << 60
        scores = [none if s is None else s for s in scores]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, n log n for slices of any length."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != stop:
                continue
            alive[middle] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (joined := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (joined, i, end[stop]))
            if before[i] >= 0 and (joined := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (joined, before[i], stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder for the ranks in the text of a rank file."""

    def __init__(self, rank_file: bytes):
        self.ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        self.scanner = Scanner()
        self.merger = Merger(self.ranks)
        spare = max(self.ranks.values()) + 1
        tokens = [b""] * spare
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids_of = self.merger.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, cut)), "<u4") for cut in self.scanner.slices(texts)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the text's bytes, then their number."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """Each token's bytes, copied to its offset."""
        offsets = self.offsets(ids) if offsets is None else offsets
        out = bytearray(int(offsets[-1]))
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            places = offsets[at : at + len(part)]
            stop = int(offsets[at + len(part)])
            shift = np.repeat(self.begins[part] - places, self.lengths[part])
            out[places[0] : stop] = self.bytes[shift + np.arange(places[0], stop)].tobytes()
        return bytes(out)


TOKENS = pa.schema([("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32()))])
DDL = {"ids": "array<int>", "offsets": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _codec(shared) -> Codec:
    return once_per_process(f"bpe {hashlib.sha256(shared.value).hexdigest()}", lambda: Codec(shared.value))


def _rank_file(spark, path: str):
    """The rank file, of fixed size (under 1 MB), read by the driver and sent to every executor."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _with_keys(docs: DataFrame, keys, text: str) -> DataFrame:
    return docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))


def _map_texts(docs: DataFrame, keys, text: str, shared, schema: pa.Schema, of_ids) -> DataFrame:
    source = _with_keys(docs, keys, text)
    kept = source.drop("_text").schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {DDL[n]}" for n in schema.names])

    def run(batches):
        codec = _codec(shared)
        for batch in small_batches(batches):
            rows = [of_ids(codec, ids) for ids in codec.encode(batch.column(batch.num_columns - 1).to_pylist())]
            made = record_batch(schema, *zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made.columns], names=[*batch.schema.names[:-1], *schema.names]
            )

    return source.mapInArrow(run, ddl)


def encode(docs: DataFrame, rank_path: str, keys=("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``ids`` and byte ``offsets`` (one more than ids) of every whole text, row by row.

    NULL and empty texts give no ids. Repeated rows give repeated results; other columns of
    ``docs`` are not read and cannot clash.
    """
    shared = _rank_file(docs.sparkSession, rank_path)

    def of_ids(codec, ids):
        return ids.astype(np.int32), codec.offsets(ids).astype(np.int32)

    return _map_texts(docs, keys, text, shared, TOKENS, of_ids)


def decode(tokens: DataFrame, rank_path: str, keys=("doc_id",), ids: str = "ids") -> DataFrame:
    """``keys`` and ``decoded``, the bytes of the ids; NULL ids give empty bytes."""
    shared = _rank_file(tokens.sparkSession, rank_path)
    source = tokens.select(*keys, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("_ids").schema] + ["decoded binary"])

    def run(batches):
        codec = _codec(shared)
        for batch in small_batches(batches):
            lists = batch.column(batch.num_columns - 1)
            made = pa.array([codec.decode(x.values.to_numpy()) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "decoded"])

    return source.mapInArrow(run, ddl)


def round_trip_digests(docs: DataFrame, rank_path: str, keys=("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, number of tokens, SHA-256 of the ids and of the bytes decoded from them.

    One pass over the texts, without a shuffle. NULL texts count as empty.
    """
    shared = _rank_file(docs.sparkSession, rank_path)

    def of_ids(codec, ids):
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _map_texts(docs, keys, text, shared, DIGESTS, of_ids)
