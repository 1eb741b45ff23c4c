"""Conversation structure repair by iterative-deepening A*.

A conversation's role initials should read ``(s?(ua)+)?``: an optional system row, then user
and assistant in turn.  Rows may be kept (K, 0), given the other speaker's role (R, 3) or
deleted (D, 4); rows with an empty text may be inserted (I, 3).  Blank and duplicate rows must
go, and a truncated row that stays costs 3.  Wanted are the cheapest edits and, among these,
the ASCII-least string of their initials.

``cheapest`` finds them by a depth-first search in ASCII order under a cost bound that is
raised to the least cost seen beyond it.  A transposition table holds, for each state (next
row, last role) that failed, the least cost by which it may still succeed.  The first
accepting path is therefore the cheapest and, as the search goes in ASCII order, the least.
The heuristic counts what rows must cost, and half of the cheapest edit of the rows beside
each pair of neighbours that may not follow each other: an edit mends at most two such pairs.

At scale: rows are range-partitioned by (conversation, turn), so that a conversation of any
length lies on many executors, and numbered.  A conversation is cut into blocks of at most
``BLOCK`` rows.  A whole conversation in one block is searched once.  Other blocks are searched
for every role before and after them, and the tables of blocks are folded, first within a
partition, then over partitions.  That gives the same answer: edits that end with the same row
have equally many row edits and end with one, so none is a prefix of another, and the least
string of a whole is made of least strings of its parts.  A group holds the tables of one
conversation's blocks without texts.  The repaired rows are made by a stream over sorted rows
that holds one row and one conversation's edits.

Defined cases: a null role or text is one space, and a null conversation id is a conversation
of its own.  Rows are taken by turn (null first); rows of one turn by role, then by the SHA-256
of the text, so repeated rows lie side by side.  An empty role, or one with another initial,
must be changed or go.  An empty table gives an empty one.  Very long texts are neither held in
groups nor cut.  Only conv_id, turn, role and text are read, so clashing names of other columns
don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.sources.tables import materialize

BLANKS = " \t\n\x0b\f\r"
BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS
PARTITION_BITS = 33  # of monotonically_increasing_id: rows of one partition
RECORDS = 512  # repaired rows a batch

START, SYSTEM, USER, ASSISTANT, ACCEPTED = range(5)
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
KEPT_TRUNCATED = 3
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", ""
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
#: Role after an initial, by the role before it.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The speaker that an insertion or a new role gives, by the role before it.
SPEAKS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}


# --- search -------------------------------------------------------------------------------
class Search:
    """The cheapest edits of some rows, (role initial, fault), from one role to another."""

    def __init__(self, rows: Sequence[tuple[str, str]], goal: int = ACCEPTED):
        self.rows, self.goal = rows, goal
        n = len(rows)
        self.must = [0] * (n + 1)  # what the rows from i on cost at least
        self.next = [n] * (n + 1)  # the first row from i on that may stay
        self.pairs = [0] * (n + 1)  # twice the cost of the forbidden neighbours from i on; set where next[i] == i
        self.system = [False] * (n + 1)
        for i in range(n - 1, -1, -1):
            initial, fault = rows[i]
            gone = fault in (BLANK, DUPLICATE)
            self.must[i] = self.must[i + 1] + (DELETE if gone else KEPT_TRUNCATED if fault == TRUNCATED else 0)
            self.system[i] = self.system[i + 1] or (not gone and initial == "s")
            self.next[i] = self.next[i + 1] if gone else i
            if not gone:
                j = self.next[i + 1]
                if j < n:
                    beside = 0 if initial + rows[j][0] in LEGAL else min(self._change(i), self._change(j))
                    self.pairs[i] = beside + self.pairs[j]
                else:
                    self.pairs[i] = self._change(i) if goal == ACCEPTED and initial != "a" else 0

    def _change(self, i: int) -> int:
        """The least extra cost of an edit of row i that mends its pairs."""
        return DELETE - KEPT_TRUNCATED if self.rows[i][1] == TRUNCATED else REROLE

    def at_least(self, i: int, role: int) -> int:
        """A bound, never too high, on the cost from row i on after a role."""
        n, goal = len(self.rows), self.goal
        if goal == START or (goal == SYSTEM and role != START):
            return DELETE * (n - i) if role == goal else NEVER
        if goal == SYSTEM and not self.system[i]:
            return NEVER
        j = self.next[i]
        if j == n:
            twice = 2 * INSERT if goal == ACCEPTED and role in (SYSTEM, USER) else 0
        else:
            twice = self.pairs[j] + (0 if self.rows[j][0] in FOLLOWS[role] else self._change(j))
        return self.must[i] + (twice + 1) // 2

    def cheapest(self, role: int = START) -> tuple[int, str] | None:
        """The least cost and its least edits; None if the goal can't be reached."""
        bound = self.at_least(0, role)
        if bound >= NEVER:
            return None
        known: dict[tuple[int, int], int] = {}  # states that failed, and the least they may cost
        path: list[str] = []
        while lack := self._descend(0, role, bound, known, path):
            bound += lack
        return bound, "".join(reversed(path))

    def _descend(self, i: int, role: int, budget: int, known: dict[tuple[int, int], int], path: list[str]) -> int:
        """0 with the edits in ``path``, last first; or what the budget lacks at least."""
        state = (i, role)
        need = known.get(state)
        if need is None:
            need = self.at_least(i, role)
        if need > budget:
            return need - budget
        if i == len(self.rows) and (role == self.goal or (self.goal == ACCEPTED and role in (START, ASSISTANT))):
            return 0
        lack = NEVER
        for edit, cost, row, after in self._edits(i, role):
            short = self._descend(row, after, budget - cost, known, path)
            if not short:
                path.append(edit)
                return 0
            lack = min(lack, short)
        known[state] = budget + lack
        return lack

    def _edits(self, i: int, role: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: initial, cost, next row, role after it."""
        inside = i < len(self.rows)
        if inside:
            yield "D", DELETE, i + 1, role
        if inside or self.goal == ACCEPTED:  # insertions between two blocks belong to the later one
            yield "I", INSERT, i, SPEAKS[role]
        if inside:
            initial, fault = self.rows[i]
            if fault in (SOUND, TRUNCATED):
                extra = KEPT_TRUNCATED if fault == TRUNCATED else 0
                if initial in FOLLOWS[role]:
                    yield "K", KEEP + extra, i + 1, FOLLOWS[role][initial]
                yield "R", REROLE + extra, i + 1, SPEAKS[role]


def block_table(rows: Sequence[tuple[str, str]], first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(role before, role after, cost, edits) of a block; only the start of a first and the end of a last one."""
    made = []
    for goal in [ACCEPTED] if last else [START, SYSTEM, USER, ASSISTANT]:
        search = Search(rows, goal)
        for role in [START] if first else [START, SYSTEM, USER, ASSISTANT]:
            found = search.cheapest(role)
            if found:
                made.append((role, goal, *found))
    return made


def fold(tables: Sequence[Sequence[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The table of consecutive blocks as one, joined pairwise up a tree, so that strings are copied rarely."""
    if len(tables) == 1:
        return [*tables[0]]
    half = len(tables) // 2
    left, right = fold(tables[:half]), fold(tables[half:])
    from_role: dict[int, list[tuple[int, int, str]]] = {}
    for middle, after, cost, edits in right:
        from_role.setdefault(middle, []).append((after, cost, edits))
    ways: dict[tuple[int, int], list[tuple[int, str, str]]] = {}
    for before, middle, cost, edits in left:
        for after, more, further in from_role.get(middle, []):
            ways.setdefault((before, after), []).append((cost + more, edits, further))
    joined = []
    for (before, after), found in ways.items():
        least = min(cost for cost, _, _ in found)
        joined.append((before, after, least, min(a + b for cost, a, b in found if cost == least)))
    return joined


# --- rows ---------------------------------------------------------------------------------
def _key(conv_id: Column) -> Column:
    """A conversation's name that is never null."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after the stated damage, with nulls in role and text as one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    kind = F.crc32(F.encode(named, "utf-8")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def numbered_rows(conversations: DataFrame) -> DataFrame:
    """Rows in order: ``conv``, ``pos`` (rising within a conversation), role, text and what each shows by itself."""
    space = F.lit(" ")
    rows = conversations.select(
        _key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    ).withColumn("digest", F.sha2("text", 256))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    # Equal rows are interchangeable; the last key only spreads them over partitions.
    rows = rows.withColumn("_any", F.monotonically_increasing_id())
    return (
        rows.repartitionByRange(*order, "_any")
        .sortWithinPartitions(*order)
        .select(
            "conv", "turn", "role", "text", "digest",
            F.monotonically_increasing_id().alias("pos"),
            F.substring("role", 1, 1).alias("initial"),
            F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED).alias("looks"),
        )
    )


TABLE = "array<struct<before:int,after:int,cost:long,edits:string>>"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
PART_COLUMNS = (
    "conv string, block long, opening string, closing string, blank long, duplicate long, truncated long, illegal long, "
    f"steps {TABLE}"
)
STEP = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
PART_SCHEMA = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("opening", pa.string()), ("closing", pa.string()),
    *((c, pa.int64()) for c in COUNTS), ("steps", pa.list_(STEP)),
])


def searched_blocks(rows: DataFrame) -> DataFrame:
    """One row per block of a conversation: its counts and its table of cheapest edits."""
    narrow = rows.select("conv", "pos", "initial", "looks")
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(1).alias("mark"))
    ends = rows.groupBy("conv").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    marks = firsts.union(ends.select("a", F.lit(2))).union(ends.select("z", F.lit(4)))
    marks = marks.groupBy("pos").agg(F.sum("mark").alias("marks"))
    marked = narrow.join(marks, "pos", "left").withColumn("marks", F.coalesce("marks", F.lit(0)))
    fault = F.when(F.col("looks") == BLANK, BLANK).when(F.col("marks").bitwiseAND(1) == 0, DUPLICATE).otherwise(F.col("looks"))
    blocks = (
        marked.withColumn("block", F.shiftright("pos", BLOCK_BITS))
        .groupBy("conv", "block")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "initial", fault.alias("fault")))).alias("rows"),
            F.max(F.col("marks").bitwiseAND(2) > 0).alias("first"),
            F.max(F.col("marks").bitwiseAND(4) > 0).alias("last"),
        )
        .select("conv", "block", "first", "last", F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("faults"))
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for b in batch.to_pylist():
                block = [*zip(b["initials"], b["faults"], strict=True)]
                steps = [dict(zip(("before", "after", "cost", "edits"), s, strict=True)) for s in block_table(block, b["first"], b["last"])]
                illegal = sum(x + y not in LEGAL for x, y in zip(b["initials"], b["initials"][1:], strict=False))
                count = b["faults"].count
                made.append({
                    "conv": b["conv"], "block": b["block"], "opening": b["initials"][0], "closing": b["initials"][-1],
                    "blank": count(BLANK), "duplicate": count(DUPLICATE), "truncated": count(TRUNCATED), "illegal": illegal, "steps": steps,
                })
            yield pa.RecordBatch.from_pylist(made, schema=PART_SCHEMA)

    return blocks.mapInArrow(run, PART_COLUMNS)


def folded(parts: DataFrame, shift: int) -> DataFrame:
    """Parts with equal ``block >> shift`` of a conversation as one."""
    fields = ["block", "opening", "closing", *COUNTS, "steps"]
    grouped = parts.groupBy("conv", F.shiftright("block", shift).alias("part")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for group in batch.to_pylist():
                parts = group["parts"]
                row = {"conv": group["conv"], "block": group["part"], "opening": parts[0]["opening"], "closing": parts[-1]["closing"]}
                row |= {c: sum(p[c] for p in parts) for c in COUNTS}
                row["illegal"] += sum(x["closing"] + y["opening"] not in LEGAL for x, y in zip(parts, parts[1:], strict=False))
                steps = parts[0]["steps"]
                if len(parts) > 1:
                    whole = fold([[(s["before"], s["after"], s["cost"], s["edits"]) for s in p["steps"]] for p in parts])
                    steps = [dict(zip(("before", "after", "cost", "edits"), s, strict=True)) for s in whole]
                made.append(row | {"steps": steps})
            yield pa.RecordBatch.from_pylist(made, schema=PART_SCHEMA)

    return grouped.mapInArrow(run, PART_COLUMNS)


def judged(rows: DataFrame) -> DataFrame:
    """Per conversation of ``numbered_rows``: gaps, fault counts, least cost and its edits (``audit``)."""
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("_")).groupBy("conv").agg(
        F.coalesce(
            (F.max("turn").cast("decimal(20)") - F.min("turn").cast("decimal(20)") + 1 - F.count("turn")), F.lit(0).cast("decimal(20)")
        ).alias("gaps")
    )
    within = folded(searched_blocks(rows), PARTITION_BITS - BLOCK_BITS)
    whole = folded(within, 63)
    return whole.select("conv", *COUNTS, F.col("steps")[0]["cost"].alias("cost"), F.col("steps")[0]["edits"].alias("audit")).join(
        turns.select("conv", F.least("gaps", F.lit(2**63 - 1)).cast("long").alias("gaps")), "conv"
    )


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation after its edits: ``conv``, ``row_no`` from 0, ``role``, ``text``; in order.

    A conversation's rows are sorted behind its edits and streamed; its rows stay together in a partition.
    """
    stream = audits.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")).union(
        rows.select("conv", "pos", "role", "text")
    )

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, audit, tail, at, row_no, last = None, "", 0, 0, 0, START
        for batch in batches:
            for begin in range(0, batch.num_rows, RECORDS):
                for r in batch.slice(begin, RECORDS).to_pylist():
                    if r["pos"] < 0:
                        conv, audit, at, row_no, last = r["conv"], r["text"], 0, 0, START
                        tail = len(audit.rstrip("I"))  # insertions after the last row
                        continue
                    edit, role = audit[at], r["role"]
                    while edit == "I":
                        last = SPEAKS[last]
                        yield conv, row_no, ROLE_NAMES[last], ""
                        row_no, at = row_no + 1, at + 1
                        edit = audit[at]
                    at += 1
                    if edit != "D":
                        if edit == "R":
                            last = SPEAKS[last]
                            role = ROLE_NAMES[last]
                        else:
                            last = FOLLOWS[last][role[:1]]
                        yield conv, row_no, role, r["text"]
                        row_no += 1
                    while tail <= at < len(audit):
                        last = SPEAKS[last]
                        yield conv, row_no, ROLE_NAMES[last], ""
                        row_no, at = row_no + 1, at + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv", "row_no", "role", "text"], [pa.string(), pa.int64(), pa.string(), pa.string()]
        held: list[tuple] = []
        size = 0
        for row in edited(batches):
            held.append(row)
            size += len(row[3])
            if len(held) >= RECORDS or size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    ordered = stream.repartition("conv").sortWithinPartitions("conv", "pos")
    return ordered.mapInArrow(run, "conv string, row_no long, role string, text string")


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``conv`` and the SHA-256 of its ``role:text`` rows joined by newlines; streams ordered rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["conv", "repaired_sha256"])

        conv, running, done = None, None, []
        for batch in batches:
            for begin in range(0, batch.num_rows, RECORDS):
                for r in batch.slice(begin, RECORDS).to_pylist():
                    if r["conv"] != conv:
                        if running:
                            done.append((conv, running.hexdigest()))
                        conv, running = r["conv"], hashlib.sha256()
                    else:
                        running.update(b"\n")
                    running.update(f"{r['role']}:{r['text']}".encode())
            if len(done) >= RECORDS:
                yield made(done)
                done = []
        if running:
            done.append((conv, running.hexdigest()))
        if done:
            yield made(done)

    return repaired.mapInArrow(run, "conv string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest repair (``judged``), and the repaired rows."""
    rows = materialize(numbered_rows(conversations))
    verdicts = materialize(judged(rows))
    return verdicts, repaired_rows(rows, verdicts)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    verdicts, repaired = repair_conversations(damage(conversations))
    every = conversations.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id", _key(F.col("conv_id")).alias("conv"))
    whole = every.join(verdicts, "conv", "left").join(conversation_digests(repaired), "conv", "left")
    zero = F.lit(0).cast("long")
    return whole.select(
        "conv_id", *(F.coalesce(c, zero).alias(c) for c in ["gaps", *COUNTS, "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# The same by dynamic programming: for each row and last role, the least (cost, edits) is kept.
SQL = {
    "op11_conversation_repair": r"""
with recursive bits(i, k, c) as (
    select i::bigint, 0, i::bigint from range(256) t(i)
    union all select i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from bits where k < 8
), crc as (select list(c order by i) as t from bits where k = 8),
kinds as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(4294967295, list_reduce(
            list_concat([4294967295::bigint], list_transform(
                string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 as kind
    from conversations, crc
), damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from kinds, (select unnest([0, 1]) as copy) where kind <> 0 and (copy = 0 or kind = 3)
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as n,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last_char
    from damaged
), faults as (
    select *, case when last_char = '' then 'b'
            when row_number() over (partition by conv_id, role, sha256(text) order by n) > 1 then 'd'
            when last_char not in ('.', '!', '?') then 't' else '' end as fault,
        lag(role) over (partition by conv_id order by n) as role_before
    from numbered
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
        count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
        count(*) filter (n > 1 and left(role_before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal, max(n) as n
    from faults group by conv_id
), lasts as (  -- the roles a sequence may end with, '' before the first row, and which speaker comes next
    select * from (values ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) v(r, speaks)
), steps as (  -- before a row: no or one insertion, then an edit of the row
    select conv_id, n, r as before, r2 as after, ins.cost + e.cost as cost, ins.edits || e.edit as edits
    from faults, lasts l,
        lateral (select l.r as mid, 0 as cost, '' as edits union all select l.speaks, 3, 'I') ins,
        lateral (select ins.mid as r2, 4 as cost, 'D' as edit
            union all select left(role, 1), case when fault = 't' then 3 else 0 end, 'K' where fault in ('', 't')
                and (left(role, 1) = case ins.mid when '' then 'u' when 's' then 'u' when 'u' then 'a' else 'u' end or (ins.mid = '' and left(role, 1) = 's'))
            union all select case when ins.mid = 'u' then 'a' else 'u' end, case when fault = 't' then 6 else 3 end, 'R' where fault in ('', 't')) e
), paths as (
    select conv_id, 0::bigint as n, '' as last, 0::bigint as cost, '' as edits from counts
    union all
    select conv_id, n, last, best.cost, best.edits from (
        select p.conv_id, s.n, s.after as last, min({'cost': p.cost + s.cost, 'edits': p.edits || s.edits}) as best
        from paths p join steps s on s.conv_id is not distinct from p.conv_id and s.n = p.n + 1 and s.before = p.last
        group by all)
), ended as (
    select p.conv_id, min({'cost': p.cost + case last when 's' then 6 when 'u' then 3 else 0 end,
        'edits': p.edits || case last when 's' then 'II' when 'u' then 'I' else '' end}) as best
    from paths p join counts c on c.conv_id is not distinct from p.conv_id and p.n = c.n group by p.conv_id
), marks as (  -- each edit with the number of the row it belongs to; insertions come before their row
    select conv_id, place_at, substr(best.edits, place_at, 1) as edit, length(replace(substr(best.edits, 1, place_at - 1), 'I', '')) + 1 as n
    from ended, lateral (select unnest(range(1, length(best.edits) + 1)) as place_at)
), outcome as (
    select m.conv_id, m.place_at, m.edit, f.text, f.role,
        row_number() over (partition by m.conv_id order by m.place_at) as place,
        max(case when m.edit = 'K' and left(f.role, 1) = 's' then 1 else 0 end) over (partition by m.conv_id) as led
    from marks m left join faults f on f.conv_id is not distinct from m.conv_id and f.n = m.n where m.edit <> 'D'
), repaired as (
    select conv_id, string_agg(case when edit = 'K' then role when (place - led) % 2 = 1 then 'user' else 'assistant' end
        || ':' || case when edit = 'I' then '' else text end, chr(10) order by place_at) as rows
    from outcome group by conv_id
)
select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.edits, '') as audit,
    sha256(coalesce(r.rows, '')) as repaired_sha256
from (select distinct conv_id from conversations) d
left join counts c on c.conv_id is not distinct from d.conv_id
left join ended e on e.conv_id is not distinct from d.conv_id
left join repaired r on r.conv_id is not distinct from d.conv_id
"""
}
