"""Chat formatting with minimum-cost role repair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import few, freed, named, stored

ROLES = ("system", "user", "assistant")
#: Which role may follow which; "" is the beginning. A conversation may end after `user` or `assistant` alone.
LEGAL = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
STATES = tuple(LEGAL)
ENDS = frozenset({"user", "assistant"})
ACTIONS = ("keep", "merge", "relabel", "merge and relabel")
NEVER = 1 << 60
#: A piece of conversations ends after so many turns or bytes of text.
ROWS_PER_PIECE, PIECE_BYTES = 4096, 4 << 20
#: Pieces whose ends are sent to every executor; beyond, ends and pieces are shuffled to each other.
SENT_PIECES = 50_000
HEAD, TAIL, JOIN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"


@dataclass(frozen=True)
class Costs:
    """What repairs cost; keeping a legal turn costs nothing, several repairs of one turn cost their sum."""

    merge: int = 2
    insert: int = 3
    relabel: int = 4
    unknown: int = 1  #: relabelling a role outside ROLES, null included
    no_end: int = 3  #: ending after a system turn alone, by an empty user turn


@dataclass(frozen=True)
class Move:
    """What one turn becomes in one state: empty turns before it, then its own role, merged into the turn before or not."""

    cost: int
    to: int
    inserted: tuple[str, ...]
    role: str
    action: str

    @property
    def merged(self) -> bool:
        return self.action.startswith("merge")

    @property
    def turns(self) -> int:
        return len(self.inserted) + (not self.merged)


@lru_cache(4096)
def moves(role: str, state: int, costs: Costs) -> tuple[Move, ...]:
    """The cheapest move to each state, in the states' order; ties go to the fewest insertions, then to the order of ACTIONS."""
    best: dict[int, tuple] = {}

    def offer(cost: int, inserted: tuple[str, ...], new: str, action: str) -> None:
        m = Move(cost, STATES.index(new), inserted, new, action)
        key = (cost, len(inserted), ACTIONS.index(action))
        if m.to not in best or key < best[m.to][0]:
            best[m.to] = (key, m)

    for new in ROLES:
        changed = new != role
        price = 0 if not changed else costs.relabel if role in ROLES else costs.unknown
        if STATES[state] == new:
            offer(price + costs.merge, (), new, ACTIONS[1 + 2 * changed])
        # The shortest run of empty turns after which the role is legal.
        runs = [((), STATES[state])]
        for _ in STATES:
            if legal := [run for run, at in runs if new in LEGAL[at]]:
                offer(price + costs.insert * len(legal[0]), legal[0], new, ACTIONS[2 * changed])
                break
            runs = [((*run, x), x) for run, at in runs for x in LEGAL[at] if x != "system"]
    return tuple(m for _, m in sorted(best.values(), key=lambda x: x[1].to))


def ways(roles: list[str], start: int, costs: Costs) -> tuple[list[int], list[list]]:
    """The least cost of being in each state after these turns from `start`; and for each turn, how each state is reached."""
    cost, taken = [0 if s == start else NEVER for s in range(len(STATES))], []
    for role in roles:
        new, by = [NEVER] * len(STATES), [None] * len(STATES)
        for s, so_far in enumerate(cost):
            if so_far < NEVER:
                for m in moves(role, s, costs):
                    if so_far + m.cost < new[m.to]:
                        new[m.to], by[m.to] = so_far + m.cost, (s, m)
        cost = new
        taken.append(by)
    return cost, taken


def chosen(taken: list[list], end: int) -> list[Move]:
    """The moves that led to `end`."""
    out = []
    for by in reversed(taken):
        end, m = by[end]
        out.append(m)
    return out[::-1]


def last_state(cost: list[int], costs: Costs) -> int:
    """The state in which a conversation ends at the least cost."""
    extra = lambda s: 0 if STATES[s] in ENDS else costs.no_end
    return min((s for s in range(len(STATES)) if STATES[s]), key=lambda s: (cost[s] + extra(s), s))


def crossings(roles: list[str], costs: Costs) -> list[int]:
    """For a piece of a conversation, from each state to each: the least cost and the turns that then come out, as one flat list."""
    flat = []
    for start in range(len(STATES)):
        cost, taken = ways(roles, start, costs)
        for s, c in enumerate(cost):
            flat += [c, sum(m.turns for m in chosen(taken, s)) if c < NEVER else 0]
    return flat


def through(pieces: list[list[int]], costs: Costs) -> list[tuple[int, int, int]]:
    """For each piece of one conversation, by the pieces' crossings: its first state, its last, and the turns that come out before it."""
    k = len(STATES)
    cost, back = [0] + [NEVER] * (k - 1), []
    for flat in pieces:
        new, by = [NEVER] * k, [0] * k
        for s in range(k):
            for t in range(k):
                if cost[s] + flat[2 * (s * k + t)] < new[t]:
                    new[t], by[t] = cost[s] + flat[2 * (s * k + t)], s
        cost = new
        back.append(by)
    state, ends = last_state(cost, costs), []
    for by in reversed(back):
        ends.append((by[state], state))
        state = by[state]
    out, before = [], 0
    for flat, (a, z) in zip(pieces, reversed(ends), strict=True):
        out.append((a, z, before))
        before += flat[2 * (a * k + z) + 1]
    return out


def rendered(roles: list[str], texts: list[str], start: int, end: int, before: int, final: bool, costs: Costs) -> Iterator[tuple[str, str, str, int, int, str]]:
    """(role, action, inserted, cost, seq, rendering) of each turn of a piece between two known states."""
    _, taken = ways(roles, start, costs)
    seq = before - 1
    for k, (m, text) in enumerate(zip(chosen(taken, end), texts, strict=True)):
        parts = [] if seq < 0 or m.merged and not m.inserted else [TAIL]
        for role in m.inserted:
            parts += [HEAD.format(role=role), TAIL]
        parts += [JOIN if m.merged else HEAD.format(role=m.role), text]
        seq += m.turns
        if final and k == len(roles) - 1:
            parts.append(TAIL)
            if STATES[end] not in ENDS:
                parts += [HEAD.format(role="user"), TAIL]
        yield m.role, m.action, ",".join(m.inserted), m.cost, seq, "".join(parts)


def _clean(role: str | None) -> str:
    return (role or "").strip().lower()


def _runs(convs: list) -> Iterator[tuple[int, int]]:
    """Where each conversation of a piece begins and ends."""
    start = 0
    for k in range(1, len(convs) + 1):
        if k == len(convs) or convs[k] != convs[start]:
            yield start, k
            start = k


def format_chats(
    turns: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows_per_piece: int = ROWS_PER_PIECE
) -> DataFrame:
    """Every turn repaired and rendered: conv, turn, role_in, role, action, inserted, cost, seq, position, rendered.

    A conversation's turns, by turn number, are made legal (LEGAL: a system turn or none, then user and assistant in alternation)
    at the least cost, by merging turns into the one before, relabelling them or inserting empty turns before them;
    moves() settles ties of one turn; of several repairs of one cost, the one taken may depend on where pieces are cut. seq numbers the turns that come out, from 0; a merged turn has the seq of the turn that it continues. position
    numbers the rows of a conversation from 0 without gaps: its strings `rendered`, joined by position, are its rendering. Roles are trimmed and
    lower-cased, null and other ones are unknown; null texts are empty, texts may be of any length; rows of null conversations are one
    conversation; null turn numbers come first. Rows of equal turn numbers follow one another by role and text, whatever the partitions; repeated
    rows are turns of their own. An empty table gives no rows; other columns are left out, whatever their names.

    Turns are dealt by ranges of (conversation, turn), so that one which holds much of the table lies in many tasks, and cut
    to pieces of at most rows_per_piece turns and PIECE_BYTES, which are written, a row for each. Of a piece's first and last conversation, which can go
    on in others, the least costs from state to state (a table of one size) are sent and combined in order; then every piece is repaired by
    itself, where it lies, between its known ends.
    """
    spark = turns.sparkSession
    work = turns.select(named(conv_col).alias("conv"), named(turn_col).alias("turn"), named(role_col).cast("string").alias("role_in"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work.count() // (16 * rows_per_piece)))
    start = F.substring("text", 1, 64)
    ranged = work.withColumn("start", start).repartitionByRange(parts, "conv", "turn", "role_in", "start").sortWithinPartitions("conv", "turn", "role_in", "text").drop("start").withColumn("part", F.spark_partition_id())
    conv_type, turn_type = work.schema["conv"].dataType, work.schema["turn"].dataType
    integer = lambda n: T.StructField(n, T.IntegerType())
    texts = T.ArrayType(T.StringType())
    piece = T.StructType([integer("part"), integer("piece"), T.StructField("convs", T.ArrayType(conv_type)), T.StructField("turns", T.ArrayType(turn_type)), T.StructField("roles", texts), T.StructField("texts", texts)])

    @freed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, number = to_arrow_schema(piece), 0
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole[c].combine_chunks())
            columns = [pa.array([whole["part"][0].as_py()], pa.int32()), pa.array([number], pa.int32()), *(one(c) for c in ("conv", "turn", "role_in", "text"))]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            lengths = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)
            at = 0
            for k, n in enumerate(lengths.tolist(), 1):
                rows, size = rows + 1, size + n
                if rows == rows_per_piece or size >= PIECE_BYTES:
                    held.append(b.slice(at, k - at))
                    yield flush()
                    held, rows, size, number, at = [], 0, 0, number + 1, k
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield flush()

    pieces = stored(ranged.mapInArrow(cut, piece))
    cross = T.StructType([T.StructField("conv", conv_type), integer("part"), integer("piece"), integer("run"), T.StructField("rows", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType()))])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            found = []
            for x in b.to_pylist():
                runs = list(_runs(x["convs"]))
                for k in sorted({0, len(runs) - 1}):
                    a, z = runs[k]
                    found.append({"conv": x["convs"][a], "part": x["part"], "piece": x["piece"], "run": k, "rows": z - a, "costs": crossings([_clean(r) for r in x["roles"][a:z]], costs)})
            yield pa.RecordBatch.from_pylist(found, schema=to_arrow_schema(cross))

    ended = T.StructType([*(integer(n) for n in ("part", "piece", "run", "first", "last")), *(T.StructField(n, T.LongType()) for n in ("before", "position")), T.StructField("final", T.BooleanType())])

    def combine(conv: pa.Table) -> pa.Table:
        own = sorted(zip(conv["part"].to_pylist(), conv["piece"].to_pylist(), conv["run"].to_pylist(), conv["rows"].to_pylist(), conv["costs"].to_pylist(), strict=True))
        ends = through([c for *_, c in own], costs)
        position, found = 0, []
        for k, ((part, piece, run, rows, _), (first, last, before)) in enumerate(zip(own, ends, strict=True)):
            found.append((part, piece, run, first, last, before, position, k == len(own) - 1))
            position += rows
        kinds = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=ended.names)

    several = pieces.select("part", "piece", "convs", "roles").mapInArrow(tables, cross)
    ends = several.groupBy("conv").applyInArrow(combine, ended)
    of_piece = ends.groupBy("part", "piece").agg(F.collect_list(F.struct("run", "first", "last", "before", "position", "final")).alias("ends"))
    out = T.StructType(
        [T.StructField("conv", conv_type), T.StructField("turn", turn_type), *(T.StructField(n, T.StringType()) for n in ("role_in", "role", "action", "inserted")), *(T.StructField(n, T.LongType()) for n in ("cost", "seq", "position")), T.StructField("rendered", T.StringType())]
    )

    @freed
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            for k in range(b.num_rows):
                x = b.slice(k, 1).to_pylist()[0]
                known = {e["run"]: (e["first"], e["last"], e["before"], e["position"], e["final"]) for e in x["ends"]}
                found: list[list] = [[] for _ in schema]
                for run, (a, z) in enumerate(_runs(x["convs"])):
                    roles = [_clean(r) for r in x["roles"][a:z]]
                    first, last, before, position, final = known.get(run) or (0, last_state(ways(roles, 0, costs)[0], costs), 0, 0, True)
                    for i, (role, action, inserted, cost, seq, text) in enumerate(rendered(roles, x["texts"][a:z], first, last, before, final, costs)):
                        for column, value in zip(found, (x["convs"][a + i], x["turns"][a + i], x["roles"][a + i], role, action, inserted, cost, seq, position + i, text), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    # One short row for each piece: sent to all tasks while they are few.
    done = pieces.join(few(stored(of_piece), SENT_PIECES), ["part", "piece"]).select("ends", "convs", "turns", "roles", "texts").mapInArrow(repair, out)
    return done.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
