"""Conversation structure repair by lazy weighted determinisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.frames import drop, freed, named, stored

#: What edits cost. Keep is free; an undeleted truncated row costs its own on top.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of the legal roles (s?(ua)+)?: at the start, after s, u and a. NEXT has what a role's initial leads to, OWED the role that may be put in.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
OWED = ("user", "user", "assistant", "user")
NEVER = 1 << 50
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
#: A symbol is 0 for a row that must go, else 1 + 2 x (place of the role's initial in INITIALS, 3 for others) + (1 if truncated).
GONE = 0
#: A piece of a conversation ends after so many rows or bytes of text.
ROWS_PER_PIECE, PIECE_BYTES = 4096, 4 << 20


def _owed(q: int) -> int:
    return NEXT[q][OWED[q][0]]


def _closed(v: list[int]) -> list[int]:
    """v where turns may be put in before the next row. A turn put in leads to u or a alone, so two passes reach all."""
    for _ in range(2):
        v = [min(v[q], INSERT + v[_owed(q)]) for q in range(4)]
    return v


class Repairs:
    """The determinised automaton, read from a conversation's end to its beginning.

    A state is a vector with, for each state of the legal roles, what the rows to the right cost from there, less the least of them. The vectors that
    occur are few; a step is worked out once for each vector and symbol and then looked up.
    """

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list] = []
        self.arcs: dict[tuple[int, int, int], tuple[str, int, tuple[str, ...], str | None]] = {}
        self.end = self.state(_closed([0, NEVER, NEVER, 0]))[0]
        self.units = [self.state([0 if p == q else NEVER for p in range(4)])[0] for q in range(4)]

    def state(self, v) -> tuple[int, int]:
        """(number, least cost) of a vector."""
        least = min(v)
        key = tuple(NEVER if x >= NEVER else x - least for x in v)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
            self.table.append([None] * 9)
        return self.number[key], least

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(state, cost) one row further to the left."""
        found = self.table[state][symbol]
        if found is None:
            right = self.vectors[state]
            v = [min(cost + right[p] for _, cost, p in self.ways(q, symbol)) for q in range(4)]
            found = self.table[state][symbol] = self.state([min(x, NEVER) for x in _closed(v)])
        return found

    @staticmethod
    def ways(q: int, symbol: int) -> list[tuple[str, int, int]]:
        """(edit, cost, state behind it) of a row in state q, in the order of the edits' initials."""
        found = [("D", DELETE, q)]
        if symbol != GONE:
            initial, truncated = divmod(symbol - 1, 2)
            if initial < 3 and (p := NEXT[q].get(INITIALS[initial])) is not None:
                found.append(("K", TRUNCATED * truncated, p))
            found.append(("R", REROLE + TRUNCATED * truncated, _owed(q)))
        return found

    def scan(self, symbols: bytes, copies: list[int], state: int) -> tuple[list[int], list[int], int]:
        """(states before each row, states behind each row's first copy, cost) for rows whose right end is in `state`."""
        n, cost = len(symbols), 0
        before, behind = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if copies[i] > 1:  # further copies go; after the first of them the state stays
                state, w = self.step(state, GONE)
                cost += w + DELETE * (copies[i] - 2)
            behind[i] = state
            state, w = self.step(state, symbols[i])
            before[i] = state
            cost += w
        return before, behind, cost

    def arc(self, before: int, behind: int, symbol: int, q: int) -> tuple[str, int, tuple[str, ...], str | None]:
        """(edits, state behind, roles put in, what becomes of the row: D, K or its new role) along tight arcs, the least initial first."""
        key = (behind, symbol, q)
        if key not in self.arcs:
            cost, left, right = self.table[behind][symbol][1], self.vectors[before], self.vectors[behind]
            edits, put, at = "", [], q
            while True:
                tight = {e: p for e, c, p in self.ways(at, symbol) if c + right[p] == left[at] + cost}
                if "D" not in tight and INSERT + left[_owed(at)] == left[at]:
                    edits += "I"
                    put.append(OWED[at])
                    at = _owed(at)
                    continue
                edit = min(tight)
                self.arcs[key] = edits + edit, tight[edit], tuple(put), OWED[at] if edit == "R" else edit
                break
        return self.arcs[key]

    def trace(self, symbols: bytes, copies: list[int], before: list[int], behind: list[int], q: int) -> Iterator[tuple[str, int, tuple[str, ...], str | None]]:
        for i, symbol in enumerate(symbols):
            edits, q, put, becomes = self.arc(before[i], behind[i], symbol, q)
            yield edits + "D" * (copies[i] - 1), q, put, becomes

    def closing(self, q: int) -> list[str]:
        """Roles put in after the last row."""
        put, end = [], self.vectors[self.end]
        while end[q]:
            put.append(OWED[q])
            q = _owed(q)
        return put


@lru_cache(1)
def automaton() -> Repairs:
    return Repairs()


def _symbol(gone: Column, truncated: Column) -> Column:
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(gone, GONE).otherwise(1 + 2 * place + truncated.cast("int"))


def _pieces(rows: DataFrame) -> DataFrame:
    """Sorted rows (conv, turn, role, text, copies, blank, duplicate, truncated) in pieces of one conversation; `alone` ones are certainly whole conversations."""
    conv, turn = rows.schema["conv"].dataType, rows.schema["turn"].dataType
    text, many = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    fields = [("conv", conv), ("seq", T.LongType()), ("alone", T.BooleanType()), ("symbols", T.BinaryType()), ("copies", many), ("roles", text), ("texts", text)]
    fields += [(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal", "turns")] + [("least", turn), ("most", turn), ("first", T.StringType()), ("last", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def row(part: int, k: int, own: list[dict], alone: bool) -> dict:
        turns = [r["turn"] for r in own if r["turn"] is not None]
        initials = [r["role"][:1] for r in own]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        more = [r["copies"] - 1 for r in own]
        return {
            "conv": own[0]["conv"], "seq": (part << 32) + k, "alone": alone, "symbols": bytes(r["symbol"] for r in own), "copies": [r["copies"] for r in own], "roles": [r["role"] for r in own], "texts": [r["text"] for r in own],
            "blank": sum(r["copies"] for r in own if r["blank"]), "duplicate": sum(r["duplicate"] + m for r, m in zip(own, more, strict=True) if not r["blank"]), "truncated": sum(r["truncated"] for r in own),
            "illegal": pairs + sum(more), "turns": sum(a != b for a, b in zip(turns, [None, *turns], strict=False)), "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "first": initials[0], "last": initials[-1],
        }

    @freed
    def cut(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        part, arrow = TaskContext.get().partitionId(), to_arrow_schema(schema)
        own, held, k, of = [], 0, 0, 0  # rows of the piece, their bytes, pieces so far, pieces of this conversation
        out: list[dict] = []
        size = 0
        for b in batches:
            for r in b.to_pylist():
                new = bool(own) and r["conv"] != own[0]["conv"]
                if new or len(own) >= ROWS_PER_PIECE or held >= PIECE_BYTES:
                    out.append(row(part, k, own, new and of == 0 and k > 0))
                    own, size, held, k, of = [], size + held, 0, k + 1, 0 if new else of + 1
                    if size >= PIECE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, size = [], 0
                own.append(r)
                held += len(r["text"]) + len(r["role"]) + 64
        if own:
            out.append(row(part, k, own, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    work = rows.withColumn("symbol", _symbol(F.col("blank") | F.col("duplicate"), F.col("truncated"))).select("conv", "turn", "role", "text", "copies", "blank", "duplicate", "truncated", "symbol", "key")
    return work.repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key").drop("key").mapInArrow(cut, schema)


def _in_order(df: DataFrame, order: Column | str, schema: T.StructType, step) -> DataFrame:
    """step(own, carried) -> (row or None, carried) over each conversation's rows in order, carried being None at its first; streamed, so a conversation of any length fits."""

    @freed
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, last, carried = to_arrow_schema(schema), None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if last is None or r["conv"] != last[0]:
                    last, carried = (r["conv"],), None
                found, carried = step(r, carried)
                out.append({"conv": r["conv"], "seq": r["seq"], **found})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition("conv").sortWithinPartitions("conv", order).mapInArrow(run, schema)


def _ends(several: DataFrame) -> DataFrame:
    """(conv, seq, right array<long>, entry int, closes boolean) of pieces of conversations that may have more than one.

    Each piece is scanned once from each state that its right end may have. Going left over the pieces' results, 16 numbers each, gives the vector at
    each right end; with it each piece is traced from each state at its left, and going right over those gives the state that it is entered in.
    """
    conv = T.StructField("conv", several.schema["conv"].dataType)
    key = [conv, T.StructField("seq", T.LongType())]
    longs = T.ArrayType(T.LongType())

    @freed
    def across(batches):
        rep = automaton()
        for b in batches:
            for r in b.to_pylist():
                costs = []
                for unit in rep.units:
                    before, _, cost = rep.scan(r["symbols"], r["copies"], unit)
                    costs.extend(min(NEVER, cost + x) for x in rep.vectors[before[0]])
                yield pa.RecordBatch.from_pylist([{"conv": r["conv"], "seq": r["seq"], "costs": costs}], schema=_arrow(key, ("costs", longs)))

    def leftward(r, v):
        closes = v is None
        v = v or list(automaton().vectors[automaton().end])
        c = r["costs"]
        new = [min(min(NEVER, c[4 * p + q] + v[p]) for p in range(4)) for q in range(4)]
        low = min(new)
        return {"right": v, "closes": closes}, [min(NEVER, x - low) if x < NEVER else NEVER for x in new]

    crossed = several.select("conv", "seq", "symbols", "copies").mapInArrow(across, T.StructType([*key, T.StructField("costs", longs)]))
    right = stored(_in_order(crossed, F.desc("seq"), T.StructType([*key, T.StructField("right", longs), T.StructField("closes", T.BooleanType())]), leftward))

    @freed
    def through(batches):
        rep = automaton()
        for b in batches:
            for r in b.to_pylist():
                before, behind, _ = rep.scan(r["symbols"], r["copies"], rep.state(r["right"])[0])
                exits = []
                for q in range(4):
                    for _, p, _, _ in rep.trace(r["symbols"], r["copies"], before, behind, q):
                        pass
                    exits.append(p)
                yield pa.RecordBatch.from_pylist([{"conv": r["conv"], "seq": r["seq"], "exits": exits}], schema=_arrow(key, ("exits", longs)))

    def rightward(r, q):
        return {"entry": q or 0}, r["exits"][q or 0]

    joined = several.select("conv", "seq", "symbols", "copies").join(right.select("seq", "right"), "seq").select("conv", "seq", "symbols", "copies", "right")
    passed = joined.mapInArrow(through, T.StructType([*key, T.StructField("exits", longs)]))
    entries = _in_order(passed, "seq", T.StructType([*key, T.StructField("entry", T.LongType())]), rightward)
    return right.select("seq", "right", "closes").join(entries.select("seq", "entry"), "seq")


def _arrow(key: list[T.StructField], *more) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType([*key, *(T.StructField(*m) for m in more)]))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Repaired conversations in pieces: (conv, seq, alone, blank, duplicate, truncated, illegal, turns, least, most, first, last, cost, edits, repaired). Stored.

    A conversation's pieces by seq are its rows by turn, null first; rows of one turn lie by a hash of role and text, so equal ones lie side by side. Most conversations
    are one piece. `edits` has the initial of each edit of the cheapest repair, the ASCII-least of several; `repaired` the role and text of the rows that
    it leaves or puts in. Blank rows and such as repeat an earlier role and text must go. Null roles and texts are one blank, null ids and turns values like
    others; an empty role has no legal initial. Texts of any length stay whole. Other columns are not read. An empty table gives no rows.
    copies_col names a column with how often a row stands there.

    Equal rows are counted before they are shuffled, first occurrences are minima by conversation and content, and rows are sorted by ranges, so a
    conversation that holds a third of all rows lies on many tasks; of one in several pieces only costs and states go from piece to piece.
    """
    n = F.lit(1).cast("long") if copies_col is None else named(copies_col).cast("long")
    rows = turns.select(named(conv_col).alias("conv"), named(turn_col).alias("turn"), *(F.coalesce(named(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))), n.alias("copies"))
    rows = rows.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = stored(rows.groupBy("conv", "turn", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies")))
    seen = rows.groupBy(F.col("conv").alias("of"), F.col("key").alias("like")).agg(F.min(F.struct("turn")).alias("seen"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = trimmed == ""
    duplicate = ~blank & ~F.col("turn").eqNullSafe(F.col("seen.turn"))
    joined = rows.join(seen, F.col("conv").eqNullSafe(F.col("of")) & (F.col("key") == F.col("like")))
    cut = ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    judged = stored(joined.select("conv", "turn", "key", "role", "text", "copies", blank.alias("blank"), duplicate.alias("duplicate"), (~blank & ~duplicate & cut).alias("truncated")))
    drop(rows)
    pieces = stored(_pieces(judged))
    drop(judged)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("right", "array<long>"), ("closes", "boolean"), ("entry", "long"))]
    facts = ["conv", "seq", "alone", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first", "last"]
    several = pieces.where("NOT alone")
    work = pieces.where("alone").select("*", *none).unionByName(several.join(_ends(several), "seq"))
    schema = T.StructType([*(pieces.schema[c] for c in facts), T.StructField("cost", T.LongType()), T.StructField("edits", T.StringType()), T.StructField("repaired", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))])

    @freed
    def repair(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        rep, arrow = automaton(), to_arrow_schema(schema)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(k, 256).to_pylist():
                    closes, q = r["closes"] is not False, r["entry"] or 0
                    before, behind, _ = rep.scan(r["symbols"], r["copies"], rep.end if r["right"] is None else rep.state(r["right"])[0])
                    edits, repaired = [], []
                    for i, (done, q, put, becomes) in enumerate(rep.trace(r["symbols"], r["copies"], before, behind, q)):
                        edits.append(done)
                        repaired.extend((p, "") for p in put)
                        if becomes != "D":
                            repaired.append((r["roles"][i] if becomes == "K" else becomes, r["texts"][i]))
                    if closes:
                        put = rep.closing(q)
                        edits.append("I" * len(put))
                        repaired.extend((p, "") for p in put)
                    edits = "".join(edits)
                    kept = sum(TRUNCATED for i, e in enumerate(_last_edits(edits, r["copies"])) if e != "D" and r["symbols"][i] != GONE and (r["symbols"][i] - 1) % 2)
                    cost = DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R") + kept
                    out.append({**{c: r[c] for c in facts}, "cost": cost, "edits": edits, "repaired": [{"role": a, "text": t} for a, t in repaired]})
                yield pa.RecordBatch.from_pylist(out, arrow)

    columns = [*facts, "symbols", "copies", "roles", "texts", "right", "closes", "entry"]
    done = stored(work.select(*columns).mapInArrow(repair, schema))
    drop(pieces)
    return done


def _last_edits(edits: str, copies: list[int]) -> Iterator[str]:
    """The edit of each row's first copy."""
    at = 0
    for n in copies:
        while edits[at] == "I":
            at += 1
        yield edits[at]
        at += n


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with the damage that the number of a row's id and turn names, nulls as one blank: (conv_id, turn, role, text, copies)."""
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _summed(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of its pieces, sorted by conv and seq within partitions: counts added, edits joined, the repaired rows' digest."""
    schema = T.StructType([pieces.schema["conv"], *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    @freed
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        own: dict | None = None

        def row() -> dict:
            gaps = 0 if own["most"] is None else own["most"] - own["least"] + 1 - own["turns"]
            return {**{c: own[c] for c in ("conv", "blank", "duplicate", "truncated", "illegal", "cost")}, "gaps": gaps, "audit": "".join(own["edits"]), "repaired_sha256": own["sha"].hexdigest()}

        for b in batches:
            out = []
            for r in b.to_pylist():
                if own is None or own["conv"] != r["conv"]:
                    if own is not None:
                        out.append(row())
                    own = {"conv": r["conv"], "least": None, "most": None, "turns": 0, "last": None, "edits": [], "sha": sha256(), "any": False, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)}
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    own[c] += r[c]
                if own["last"] is not None:
                    own["illegal"] += own["last"] + r["first"] not in ("su", "ua", "au")
                own["last"] = r["last"]
                if r["least"] is not None:
                    own["turns"] += r["turns"] - (own["most"] == r["least"])
                    own["least"] = r["least"] if own["least"] is None else own["least"]
                    own["most"] = r["most"]
                own["edits"].append(r["edits"])
                for x in r["repaired"]:
                    own["sha"].update(("\n" if own["any"] else "").encode() + f"{x['role']}:{x['text']}".encode())
                    own["any"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if own is not None:
            yield pa.RecordBatch.from_pylist([row()], arrow)

    return pieces.mapInArrow(run, schema)


def op13_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    pieces = repair_conversations(damaged(rows), copies_col="copies")
    several = pieces.where("NOT alone").repartition("conv").sortWithinPartitions("conv", "seq")
    known = _summed(pieces.where("alone")).unionByName(_summed(several))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    ids = rows.select("conv_id").distinct()
    joined = ids.join(known, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
