"""Conversation structure repair: the cheapest edits that make the roles' initials ``(s?(ua)+)?``.

Keeping a turn costs nothing, giving it the role that is due (user or assistant) 2, deleting it 3, inserting an empty turn of the
role that is due 2.  Blank turns and repeated ones must go; a truncated turn that stays costs 1 more.  Of the cheapest
audits (the edits' initials in order) the ASCII-least is taken.

Four states say what came last: nothing, a system turn, a user's, an assistant's.  Conversations of like length form one
bucket; going back in time, the costs to the end of all conversations of a bucket and all states are one NumPy step for each
turn.  All costs are kept, and going forward again one vectorised step for each turn takes the least edit that is still cheapest.
In each state one role only is due, so an initial determines the edit, and the greedy choice is the least audit.

Turns of a conversation meet in one task, sorted, and tasks hold a bounded number of turns at a time.  A conversation of
more than ``LONG`` turns is spread: its sorted turns are cut into pieces of at most ``PIECE``, each piece gives a matrix of costs
from any state to any state, the matrices of a conversation are composed, and each piece then traces its own edits
between the states that it was given.  So results come in pieces; a shorter conversation is one piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LONG = 1 << 15
PIECE_BITS = 14
#: Turns that a task holds at a time, bytes of their texts, and cells of a bucket.
HELD_TURNS, HELD_BYTES, CELLS = 1 << 17, 64 << 20, 1 << 20

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role due in each state, and the state that it leads to.
DUE = ("user", "user", "assistant", "user")
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Where keeping a turn of class (u, a, s, other) leads from each state; 4 is nowhere.
NOWHERE, NEVER = 4, 1 << 60
KEEPS = np.array([[USER, NOWHERE, SYSTEM, NOWHERE], [USER, NOWHERE, NOWHERE, NOWHERE], [NOWHERE, ASSISTANT, NOWHERE, NOWHERE], [USER, NOWHERE, NOWHERE, NOWHERE]])
#: Cost of ending in each state.
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
D, I, K, R = b"DIKR"
BLANK = r"[^\x20\x09-\x0D]"
_SPACE = " \t\n\x0b\f\r"


def costs(kinds, gone, extra, live, ends):
    """Costs to the end before each turn, ``[turn, conversation, state]``, from those after the last.

    ``kinds, gone, extra, live`` are ``[turn, conversation]``: class of the role, must it go, cost of staying, is it a turn at all.
    """
    steps, n = kinds.shape
    out = np.empty((steps + 1, n, 4), np.int64)
    out[steps] = ends
    padded = np.full((n, 5), NEVER, np.int64)
    for t in range(steps - 1, -1, -1):
        after = padded[:, :4] = out[t + 1]
        stay = np.where(gone[t], NEVER, extra[t])[:, None]
        best = np.minimum(np.take_along_axis(padded, KEEPS.T[kinds[t]], 1) + stay, after[:, NEXT] + REROLE + stay)
        best = np.minimum(best, after + DELETE)
        for _ in range(3):
            best = np.minimum(best, best[:, NEXT] + INSERT)
        out[t] = np.where(live[t][:, None], best, after)
    return out


def traces(cost, kinds, gone, extra, live, states, last: bool):
    """(edits' initials ``[conversation, ...]`` with zeros between, states at the end) of the least audits from given states."""
    steps, n = kinds.shape
    edits = np.zeros((steps + 1, n, 4), np.uint8)
    every, state = np.arange(n), states.copy()
    padded = np.full((n, 5), NEVER, np.int64)
    for t in range(steps):
        padded[:, :4] = cost[t + 1]
        pending = live[t].copy()
        for k in range(4):
            now = cost[t][every, state]
            drop = pending & (padded[every, state] + DELETE == now)
            insert = pending & ~drop & (cost[t][every, NEXT[state]] + INSERT == now)
            rest = pending & ~drop & ~insert
            to = KEEPS[state, kinds[t]]
            keep = rest & ~gone[t] & (padded[every, to] + extra[t] == now)
            edits[t, :, k] = np.select([drop, insert, keep, rest], [D, I, K, R], 0)
            state = np.where(keep, to, np.where(insert | rest, NEXT[state], state))
            pending = insert
            if not pending.any():
                break
    for k in range(2 if last else 0):
        short = (state == SYSTEM) | (state == USER)
        edits[steps, :, k] = np.where(short, I, 0)
        state = np.where(short, NEXT[state], state)
    return edits.transpose(1, 0, 2).reshape(n, -1), state


def _laid(lens, values):
    """Buckets of like length: (which sequences, ``[turn, sequence]`` arrays of the values, which cells are turns)."""
    starts = np.cumsum(lens) - lens
    sizes = 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(int)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        for lo in range(0, len(which), step := max(1, CELLS // int(size))):
            some = which[lo : lo + step]
            at = np.arange(size)[:, None]
            live = at < lens[some]
            cells = np.where(live, starts[some] + at, 0)
            yield some, [v[cells] if len(v) else np.zeros(cells.shape, v.dtype) for v in values], live


def audits(lens, kinds, gone, extra, states=None, ends=None, last: bool = True):
    """(costs, audits, end states) of sequences of turns that lie one after another in flat arrays."""
    n = len(lens)
    states = np.zeros(n, int) if states is None else states
    total, text, end = np.zeros(n, np.int64), [b""] * n, states.copy()
    for some, laid, live in _laid(lens, (kinds, gone, extra)):
        after = np.broadcast_to(ENDS, (len(some), 4)) if ends is None else ends[some]
        cost = costs(*laid, live, after)
        edits, end[some] = traces(cost, *laid, live, states[some], last)
        total[some] = cost[0][np.arange(len(some)), states[some]]
        for i, row in zip(some, edits):
            text[i] = row[row > 0].tobytes()
    return total, text, end


def turns_after(audit: bytes, roles, texts, state: int = START) -> list[tuple[str, str]]:
    """The repaired turns (role, text) of one sequence of turns."""
    out, i = [], 0
    for edit in audit:
        if edit == K:
            out.append((roles[i], texts[i]))
            state = int(KEEPS[state, kind_of(roles[i])])
        elif edit != D:
            out.append((DUE[state], texts[i] if edit == R else ""))
            state = int(NEXT[state])
        i += edit != I
    return out


def kind_of(role: str) -> int:
    return "uas".find(role[:1]) % 4 if role else 3


def _truncated(text: str) -> bool:
    return text.rstrip(_SPACE)[-1:] not in (".", "!", "?")


_LEGAL = {"su", "ua", "au"}


def examined(conversations):
    """Counts and the flat arrays of ``audits`` for lists of (turn, role, text) lists."""
    counts, kinds, gone, extra = [], [], [], []
    for turns in conversations:
        seen, blank, twice, cut, bad = set(), 0, 0, 0, 0
        before = None
        for _, role, text in turns:
            is_blank = not text.strip(_SPACE)
            is_twice = not is_blank and (role, text) in seen
            seen.add((role, text))
            is_cut = not is_blank and not is_twice and _truncated(text)
            blank, twice, cut = blank + is_blank, twice + is_twice, cut + is_cut
            bad += before is not None and before + role[:1] not in _LEGAL
            before = role[:1]
            kinds.append(kind_of(role))
            gone.append(is_blank or is_twice)
            extra.append(is_cut)
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        counts.append((gaps, blank, twice, cut, bad))
    lens = np.array([len(t) for t in conversations], np.int64)
    return counts, lens, np.array(kinds, np.int64), np.array(gone, bool), np.array(extra, np.int64)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = "array<struct<role:string,text:string>>"
_PIECES = ", ".join(["piece long", *(f"{c} long" for c in COUNTS), "audit string", f"turns {_TURNS}"])


def _rows(conversations: DataFrame) -> DataFrame:
    """The columns that are used; null roles and texts become one space.  ``digest`` stands for the text in sorts and groups."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _streamed(batches, key: int, flush, held_turns: int, held_bytes: int):
    """Hands runs of rows with equal first ``key`` columns of a sorted stream to ``flush``, many runs at a time."""
    runs: list[tuple[tuple, list]] = []
    turns = size = 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if not runs or runs[-1][0] != row[:key]:
                if turns >= held_turns or size >= held_bytes:
                    yield flush(runs)
                    runs, turns, size = [], 0, 0
                runs.append((row[:key], []))
            runs[-1][1].append(row[key:])
            turns += 1
            size += len(row[-1]) if isinstance(row[-1], str) else 0
    if runs:
        yield flush(runs)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _arrow(df: DataFrame, fields: str):
    """Arrow's schema of the id column and further fields."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType([df.schema["conv_id"], *StructType.fromDDL(fields).fields]))


def _ddl(df: DataFrame, fields: str) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {fields}"


def _short(rows: DataFrame) -> DataFrame:
    """Whole conversations of at most ``LONG`` turns, each one piece."""
    schema = _arrow(rows, _PIECES)

    def flush(runs):
        counts, lens, *flat = examined([turns for _, turns in runs])
        total, text, _ = audits(lens, *flat)
        out = []
        for ((conv_id,), turns), count, cost, audit in zip(runs, counts, total.tolist(), text):
            kept = turns_after(audit, [r for _, r, _ in turns], [t for _, _, t in turns])
            out.append((conv_id, 0, *count, cost, audit.decode(), [{"role": r, "text": t} for r, t in kept]))
        return _batch(out, schema)

    held = HELD_TURNS, HELD_BYTES
    near = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return near.select("conv_id", "turn", "role", "text").mapInArrow(lambda batches: _streamed(batches, 1, flush, *held), _ddl(rows, _PIECES))


def _long(rows: DataFrame, piece_bits: int) -> DataFrame:
    """Conversations of any length, in pieces."""
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = common.staged(laid.withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("piece", F.shiftright("at", piece_bits))
    firsts = laid.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("digest").alias("d_"), "first")
    same = laid.conv_id.eqNullSafe(F.col("c_")) & (laid.role == F.col("r_")) & (laid.digest == F.col("d_"))
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    blank, twice = end == "", F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    cut = ~end.isin(".", "!", "?")
    kind = F.coalesce(*[F.when(F.left("role", F.lit(1)) == c, i) for i, c in enumerate("uas")], F.lit(3))
    fault = F.when(blank, 1).when(twice, 2).when(cut, 3).otherwise(0)
    light = common.staged(laid.join(firsts, same, "left").select("conv_id", "piece", "at", "turn", kind.alias("kind"), fault.alias("fault")))
    dealt = light.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at")

    def arrays(runs):
        flat = [row for _, turns in runs for row in turns]
        kinds, fault = (np.array([r[i] for r in flat], np.int64) for i in (2, 3))
        return np.array([len(t) for _, t in runs], np.int64), kinds, (fault == 1) | (fault == 2), (fault == 3).astype(np.int64)

    fields = "piece long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first int, last int, matrix array<long>"
    one = _arrow(rows, fields)

    def summed(runs):
        lens, *flat = arrays(runs)
        basis = [audits(lens, *flat, states=np.full(len(runs), s), ends=np.tile(np.where(np.arange(4) == e, 0, NEVER // 2), (len(runs), 1)), last=False)[0] for s in range(4) for e in range(4)]
        out = []
        for k, ((conv_id, piece), turns) in enumerate(runs):
            numbers = [t[1] for t in turns if t[1] is not None]
            kinds = [t[2] for t in turns]
            bad = sum((a, b) not in ((2, 0), (0, 1), (1, 0)) for a, b in zip(kinds, kinds[1:]))
            faults = [sum(t[3] == f for t in turns) for f in (1, 2, 3)]
            out.append((conv_id, piece, min(numbers, default=None), max(numbers, default=None), len(set(numbers)), *faults, bad, kinds[0], kinds[-1], [int(b[k]) for b in basis]))
        return _batch(out, one)

    held = HELD_TURNS, HELD_BYTES
    sums = common.staged(dealt.mapInArrow(lambda batches: _streamed(batches, 2, summed, *held), _ddl(rows, fields)))

    fields_back = "piece long, gaps long, blank long, duplicate long, truncated long, illegal long, last_one boolean, ends array<long>"
    back = _arrow(rows, fields_back)

    def composed(runs):
        out = []
        for (conv_id,), pieces in runs:
            ends, rows_ = ENDS.astype(np.int64), []
            for k in range(len(pieces) - 1, -1, -1):
                piece, low, high, numbers, blank, twice, cut, bad, first, last, matrix = pieces[k]
                rows_.append([conv_id, piece, 0, blank, twice, cut, bad, k == len(pieces) - 1, ends.tolist()])
                ends = (np.array(matrix, np.int64).reshape(4, 4) + ends).min(axis=1)
                if k:
                    rows_[-1][6] += (pieces[k - 1][9], first) not in ((2, 0), (0, 1), (1, 0))
            known = [p for p in pieces if p[1] is not None]
            if known:
                again = sum(a[2] == b[1] for a, b in zip(known, known[1:]))
                rows_[-1][2] = known[-1][2] - known[0][1] + 1 - (sum(p[3] for p in known) - again)
            out += [tuple(r) for r in rows_]
        return _batch(out, back)

    whole = sums.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    exits = common.staged(whole.mapInArrow(lambda batches: _streamed(batches, 1, composed, *held), _ddl(rows, fields_back)))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        names = [F.col(c).alias(f"{c}_") if c in ("conv_id", "piece") else F.col(c) for c in right.columns]
        right = right.select(*names)
        return left.join(common.small(right), left.conv_id.eqNullSafe(F.col("conv_id_")) & (left.piece == F.col("piece_")))

    paths = _arrow(rows, "piece long, to array<long>")

    def walked(runs):
        lens, *flat = arrays(runs)
        ends = np.array([t[0][4] for _, t in runs], np.int64)
        final = [bool(t[0][5]) for _, t in runs]
        to = [audits(lens, *flat, states=np.full(len(runs), s), ends=ends, last=False)[2] for s in range(4)]
        return _batch([(c, p, [int(x[k]) for x in to]) for k, ((c, p), _) in enumerate(runs) if final[k] is not None], paths)

    bound = met(light, exits.select("conv_id", "piece", "ends", "last_one")).select("conv_id", "piece", "at", "turn", "kind", "fault", "ends", "last_one")
    bound = bound.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at")
    steps = common.staged(bound.mapInArrow(lambda batches: _streamed(batches, 2, walked, *held), _ddl(rows, "piece long, to array<long>")))
    entry = _arrow(rows, "piece long, state long")

    def entered(runs):
        out = []
        for (conv_id,), pieces in runs:
            state = START
            for piece, to in pieces:
                out.append((conv_id, piece, state))
                state = to[state]
        return _batch(out, entry)

    states = steps.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    states = common.staged(states.mapInArrow(lambda batches: _streamed(batches, 1, entered, *held), _ddl(rows, "piece long, state long")))
    given = common.staged(met(exits, states).select(*[exits[c] for c in exits.columns], "state"))
    schema = _arrow(rows, _PIECES)

    def flush(runs):
        lens, *flat = arrays(runs)
        heads = [t[0] for _, t in runs]
        states, ends = np.array([h[10] for h in heads]), np.array([h[4] for h in heads], np.int64)
        total, text, after = audits(lens, *flat, states=states, ends=ends, last=False)
        out = []
        for k, ((conv_id, piece), turns) in enumerate(runs):
            gaps, *faults = heads[k][5:10]
            audit = text[k]
            if heads[k][11]:
                audit += bytes([I]) * int(ENDS[after[k]] // INSERT)
            own = int(total[k] - (0 if heads[k][11] else ends[k][after[k]]))
            kept = turns_after(audit, [t[12] for t in turns], [t[13] for t in turns], int(states[k]))
            out.append((conv_id, piece, gaps, *faults, own, audit.decode(), [{"role": r, "text": t} for r, t in kept]))
        return _batch(out, schema)

    texts = laid.select(F.col("at").alias("at_"), "role", "text")
    full = met(light, given).join(texts, F.col("at") == F.col("at_"))
    full = full.select("conv_id", "piece", "at", "turn", "kind", "fault", "ends", "gaps", "blank", "duplicate", "truncated", "illegal", "state", "last_one", "role", "text")
    full = full.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at")
    return full.mapInArrow(lambda batches: _streamed(batches, 2, flush, *held), _ddl(rows, _PIECES))


def _parts(conversations: DataFrame, long: int, piece_bits: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of the conversations of at most ``long`` turns, and of the others if there are any."""
    rows = _rows(conversations)
    counts = rows.groupBy(F.col("conv_id").alias("c_")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long)
    many = common.staged(counts.select("c_", F.lit(True).alias("many")))
    if many.isEmpty():
        return _short(rows), None
    marked = rows.join(common.small(many), rows.conv_id.eqNullSafe(F.col("c_")), "left").drop("c_")
    return _short(marked.where("many is null").drop("many")), _long(marked.where("many").drop("many"), piece_bits)


def repaired(conversations: DataFrame, long: int = LONG, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Pieces of the repaired conversations of ``conv_id, turn, role, text`` rows.

    A piece has ``conv_id``, ``piece`` (their order within a conversation), ``gaps, blank, duplicate, truncated, illegal, cost``,
    which add up over a conversation, ``audit``, and the repaired ``turns`` (role, text).  A conversation of at most ``long``
    turns is one piece; a longer one has a piece for each ``2 ** piece_bits`` rows of a task.  Null roles and texts count as
    one space; turns go by number, nulls first, ties by role and by the SHA-256 of the text; null ids are one conversation.
    Other columns are not read.  No rows give no pieces.
    """
    short, spread = _parts(conversations, long, piece_bits)
    return short if spread is None else short.unionByName(spread)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by the crc32 of ``conv_id:turn`` modulo 20; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20).cast("int")
    words = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(text("role"))
    rows = conversations.withColumn("fate", fate).where("fate <> 0").select("conv_id", "turn", role.alias("role"), words.alias("text"), "fate")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")


def _digested(pieces: DataFrame) -> DataFrame:
    """Conversations of several pieces as one row each: their texts go through the hash piece by piece."""
    fields = ", ".join([*(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string"])
    schema = _arrow(pieces, fields)

    def run(batches):
        now, sums, audit, digest, some = None, [], [], hashlib.sha256(), False
        for batch in batches:
            for conv_id, _, *counts, part, lines in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        yield _batch([(now[0], *sums, "".join(audit), digest.hexdigest())], schema)
                    now, sums, audit, digest, some = (conv_id,), [0] * len(counts), [], hashlib.sha256(), False
                sums = [a + b for a, b in zip(sums, counts)]
                audit.append(part)
                if lines is not None:
                    digest.update((b"\n" if some else b"") + lines.encode())
                    some = True
        if now is not None:
            yield _batch([(now[0], *sums, "".join(audit), digest.hexdigest())], schema)

    lines = F.when(F.size("turns") > 0, _lines(F.col("turns")))
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.select("conv_id", "piece", *COUNTS, "audit", lines.alias("lines")).mapInArrow(run, _ddl(pieces, fields))


def digests(conversations: DataFrame, long: int = LONG, piece_bits: int = PIECE_BITS) -> DataFrame:
    """``repaired`` with a row for each conversation and the SHA-256 of its repaired turns in place of these."""
    short, spread = _parts(conversations, long, piece_bits)
    one = short.select("conv_id", *COUNTS, "audit", F.sha2(_lines(F.col("turns")), 256).alias("repaired_sha256"))
    return one if spread is None else one.unionByName(_digested(spread))


def op11(spark: SparkSession, sf_dir: str, long: int = LONG, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Damage and repair of all conversations, as the contract's digests; conversations that lost all turns are empty."""
    table = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = digests(damaged(table), long, piece_bits)
    ids = table.select(F.col("conv_id").alias("id_")).distinct()
    joined = ids.join(found, F.col("id_").eqNullSafe(found.conv_id), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return joined.select(F.col("id_").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
