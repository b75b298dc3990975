"""Vector bin packing of token sequences.

Every example asks for three things at once: tokens, one segment, and loss-bearing tokens; a sequence has a
limit on each.  Sequences are filled one after another.  Of the waiting pieces that fit, the one is taken
whose demand has the largest dot product with what the sequence has left, both as shares of the limits and
weighted by how scarce each resource is among the waiting pieces (Panigrahy et al., 2011).  If none fits
and pieces may be cut, the best one is cut to fill the rest.  Pieces of equal demand are one class with a number, and a
class is taken as often at once as it would be chosen in a row, so the work follows the different demands
and not the pieces.  Of a sequence that is closed before it has all its tokens the largest power of two stays, which needs no
padding; the rest waits again.

Each task packs the rows of its own input split, so nothing is shuffled and the result of a retried task is
the same; a sequence's id holds the task's partition in its high bits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
#: Tokens that wait in a task before they are packed, a row counting for some at least: bounds its memory.
BUFFER_TOKENS = 2_000_000
ROW_TOKENS = 16
END_ID = 2
PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, segment int, ids binary"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


@dataclass(slots=True)
class Piece:
    row: int
    start: int
    length: int
    loss: int


class Classes:
    """Waiting pieces by their demand (tokens, segments, loss-bearing tokens)."""

    def __init__(self, limits):
        import numpy as np

        self.limits = limits
        self.need = np.zeros((64, 3), np.int64)
        self.count = np.zeros(64, np.int64)
        self.held: list[deque[Piece]] = []
        self.slot: dict[tuple[int, int], int] = {}
        self.pieces = self.tokens = 0

    def add(self, p: Piece) -> None:
        import numpy as np

        k = self.slot.get((p.length, p.loss))
        if k is None:
            k = self.slot[p.length, p.loss] = len(self.held)
            self.held.append(deque())
            if k == len(self.need):
                self.need, self.count = np.concatenate([self.need, np.zeros_like(self.need)]), np.concatenate([self.count, np.zeros_like(self.count)])
            self.need[k] = p.length, 1, p.loss
        self.held[k].append(p)
        self.count[k] += 1
        self.pieces += 1
        self.tokens += p.length

    def scarcity(self):
        """The mean share of each limit that the waiting pieces ask for; classes that ran out are forgotten."""
        import numpy as np

        live = np.flatnonzero(self.count[: len(self.held)])
        if 2 * len(live) < len(self.held):
            self.need[: len(live)], self.count[: len(live)] = self.need[live], self.count[live]
            self.count[len(live) :] = 0
            self.held = [self.held[k] for k in live]
            self.slot = {(int(a), int(c)): k for k, (a, _, c) in enumerate(self.need[: len(live)])}
        n = self.count[: len(self.held)]
        return n @ (self.need[: len(self.held)] / self.limits) / n.sum()

    def _scores(self, free, scarce):
        return self.need[: len(self.held)] / self.limits * scarce @ (free / self.limits)

    def best(self, free, scarce, whole: bool = True) -> int | None:
        """The class of the largest dot product with what is left, of those that fit or of all."""
        import numpy as np

        fits = self.count[: len(self.held)] > 0
        if whole:
            fits &= (self.need[: len(self.held)] <= free).all(axis=1)
        return int(np.argmax(np.where(fits, self._scores(free, scarce), -1.0))) if fits.any() else None

    def times(self, k: int, free, scarce) -> int:
        """How often in a row the class ``k`` would be chosen."""
        import numpy as np

        need = self.need[k]
        most = min(int(self.count[k]), int((free[need > 0] // need[need > 0]).min()))
        if most > 1:
            # Each time a class's score falls by its product with what is taken; another overtakes where lines cross.
            score, fall = self._scores(free, scarce), self._scores(need, scarce)
            rival = (self.count[: len(self.held)] > 0) & (fall < fall[k])
            if rival.any():
                most = min(most, 1 + int(((score[k] - score[rival]) / (fall[k] - fall[rival])).min()))
        return max(1, most)

    def first(self, k: int) -> Piece:
        return self.held[k][0]

    def take(self, k: int, n: int) -> list[Piece]:
        out = [self.held[k].popleft() for _ in range(n)]
        self.count[k] -= n
        self.pieces -= n
        self.tokens -= int(n * self.need[k, 0])
        return out

    def rest(self) -> list[Piece]:
        return [p for h in self.held for p in h]


class Packer:
    """Packs pieces into sequences.  ``loss`` gives, for a row and a token range, its loss-bearing tokens."""

    def __init__(self, limits: Limits, loss, cut: bool = True, trim: bool = True):
        self.limits, self.loss, self.cut, self.trim = limits, loss, cut, trim

    def pieces(self, row: int, length: int) -> Iterator[Piece]:
        """A row's pieces, none beyond a limit on its own."""
        start = 0
        while start < length:
            n = min(length - start, self.limits.tokens)
            n = self.fitting(row, start, n, self.limits.loss)
            yield Piece(row, start, n, self.loss(row, start, n))
            start += n

    def fitting(self, row: int, start: int, n: int, room: int) -> int:
        """The longest range from ``start``, at most ``n``, with at most ``room`` loss-bearing tokens."""
        if self.loss(row, start, n) <= room:
            return n
        low, high = 0, n
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.loss(row, start, mid) <= room else (low, mid)
        return low

    def pack(self, waiting: list[Piece], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
        """Sequences, and the pieces left over (none if ``last``)."""
        import numpy as np

        limits = np.array([self.limits.tokens, self.limits.segments, self.limits.loss])
        done = [[p] for p in waiting if p.length == self.limits.tokens]
        pool = Classes(limits)
        for p in sorted((p for p in waiting if p.length < self.limits.tokens), key=lambda p: (-p.length, p.row, p.start)):
            pool.add(p)
        while pool.pieces and (last or pool.tokens >= 2 * self.limits.tokens):
            scarce, free, sequence = pool.scarcity(), limits.copy(), []
            while (k := pool.best(free, scarce)) is not None:
                n = pool.times(k, free, scarce)
                free -= n * pool.need[k]
                sequence += pool.take(k, n)
            if self.cut and free[0] > 0 and free[1] > 0 and pool.pieces:
                k = pool.best(free, scarce, whole=False)
                p = pool.first(k)
                n = self.fitting(p.row, p.start, min(int(free[0]), p.length - 1), int(free[2]))
                if n > 0:
                    pool.take(k, 1)
                    sequence.append(Piece(p.row, p.start, n, self.loss(p.row, p.start, n)))
                    pool.add(Piece(p.row, p.start + n, p.length - n, self.loss(p.row, p.start + n, p.length - n)))
            if self.trim:
                sequence, over = self.trimmed(sequence)
                for p in over:
                    pool.add(p)
            done.append(sequence)
        return done, pool.rest()

    def trimmed(self, sequence: list[Piece]) -> tuple[list[Piece], list[Piece]]:
        """A sequence that is not full cut to the largest power of two, which needs no padding, and what is over."""
        total = sum(p.length for p in sequence)
        room = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        kept, over = [], []
        for p in sequence:
            n = min(room, p.length)
            if n:
                kept.append(p if n == p.length else Piece(p.row, p.start, n, self.loss(p.row, p.start, n)))
            if n < p.length:
                over.append(p if not n else Piece(p.row, p.start + n, p.length - n, self.loss(p.row, p.start + n, p.length - n)))
            room -= n
        return kept, over


def pack(
    docs: DataFrame, vocabulary: str | None = None, limits: Limits = Limits(), end_id: int = END_ID, mask: str | None = None, trim: bool | None = None
) -> DataFrame:
    """Encodes ``doc_id, text`` rows and packs them into sequences; one row per piece, with its ids as bytes.

    A null text is empty, an empty text still has the end id, a null doc_id stays null and repeated rows are
    packed as often as they come.  Very long texts are cut into pieces.  Other columns are not read.
    ``mask`` names an array<int> column of alternating run lengths (not bearing loss, bearing loss, ...) in
    tokens, for instruction data; without it every token bears loss but a document's first, which nothing
    precedes.  An empty table gives no rows.
    ``trim`` cuts sequences that are closed early to powers of two.  Without it, which is the default with a mask, examples
    are cut only where they fill a sequence, and short sequences are padded.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    if mask:
        columns.append(F.col(mask).cast("array<int>").alias("runs"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = tokens.encoder(vocabulary)
        base = TaskContext.get().partitionId() << 36
        sequence = 0
        ids: dict[int, bytes] = {}
        rows: dict[int, tuple] = {}
        bearing: dict[int, np.ndarray] = {}
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset")), ("segment", pa.int32()), ("ids", pa.binary())])
        end = np.array([end_id], "<u4").tobytes()

        def loss(row, start, n):
            c = bearing.get(row)
            return n - (start == 0 < n) if c is None else int(c[start + n] - c[start])

        packer = Packer(limits, loss, trim=not mask if trim is None else trim)

        def emit(sequences):
            nonlocal sequence
            cols = {f.name: [] for f in schema}
            for s in sequences:
                at = 0
                for k, p in enumerate(s):
                    doc, total = rows[p.row]
                    for name, v in zip(cols, (doc, p.start, p.length, total, p.loss, base + sequence, at, k, ids[p.row][4 * p.start : 4 * (p.start + p.length)])):
                        cols[name].append(v)
                    at += p.length
                sequence += 1
            return pa.RecordBatch.from_pydict(cols, schema=schema)

        waiting, held, n_row = [], 0, 0
        for batch in batches:
            docs_, runs = batch.column(0).to_pylist(), batch.column(2).to_pylist() if mask else None
            for lo in range(0, batch.num_rows, 2048):
                got = enc.encode(batch.column(1).slice(lo, 2048))
                for j, b in enumerate(got):
                    b += end
                    n = len(b) // 4
                    ids[n_row], rows[n_row] = b, (docs_[lo + j], n)
                    if runs and runs[lo + j] is not None:
                        r = np.asarray(runs[lo + j], int)
                        flags = np.repeat(np.arange(len(r)) % 2, r)[:n]
                        flags = np.concatenate([flags, np.full(n - len(flags), flags[-1] if len(flags) else 1)])
                        bearing[n_row] = np.concatenate([[0], np.cumsum(flags)])
                    waiting.extend(packer.pieces(n_row, n))
                    held += max(n, ROW_TOKENS)
                    n_row += 1
                if held >= BUFFER_TOKENS:
                    done, waiting = packer.pack(waiting, False)
                    yield emit(done)
                    keep = {p.row for p in waiting}
                    ids, rows = {k: v for k, v in ids.items() if k in keep}, {k: v for k, v in rows.items() if k in keep}
                    bearing = {k: v for k, v in bearing.items() if k in keep}
                    held = sum(max(p.length, ROW_TOKENS) for p in waiting)
        yield emit(packer.pack(waiting, True)[0])

    return docs.select(*columns).mapInArrow(run, PIECE_SCHEMA)


def op1(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the contract's digest columns."""
    packed = pack(common.table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens"
    )
