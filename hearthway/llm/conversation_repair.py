"""Repair of conversation structure: the cheapest edits that make the roles alternate, found by iterative deepening.

A conversation is a string of rows, each with the initial of its role and its fault. Edits keep, rerole or delete a row
or insert an empty turn; their initials in order are the audit, and of the cheapest audits that give the roles
``(s?(ua)+)?`` the ASCII-least is taken. The next role is always forced (only the first may be ``s`` or ``u``), so an audit
tells the repaired conversation.

Long conversations are cut into stretches of a bounded number of rows. Stretches know what it costs to come from each
state of the grammar to each other; a scan from the end tells each stretch what all that follows costs, then the stretches
are searched by themselves, and a scan from the start picks the audits that fit together. Only turns' codes take part; texts stay
in their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each, scan, settle

#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States of the grammar by the last role given: nothing yet, system, user, assistant; what may follow each, and the next state.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FORCED = "uuau"  # the role that an insertion or a new role gives
ACCEPTED = (NOTHING, ASSISTANT)

#: Rows of a stretch are those with the same place but for so many bits.
STRETCH_BITS = 7
NEVER = 1 << 40

Edit = tuple[str, int, int, int]  # initial, cost, rows used, next state


def edits(row: str | None, state: int) -> Iterator[Edit]:
    """What can be done in ``state`` before or with a row (initial and fault: B blank, D duplicate, T truncated, - none), in ASCII order."""
    if row:
        yield "D", DELETE, 1, state
    yield "I", INSERT, 0, NEXT[state][FORCED[state]]
    if row and row[1] not in "BD":
        more = TRUNCATED if row[1] == "T" else 0
        if row[0] in NEXT[state]:
            yield "K", more, 1, NEXT[state][row[0]]
        yield "R", REROLE + more, 1, NEXT[state][FORCED[state]]


def least(row: str) -> int:
    """What a row costs at least, whatever the state."""
    return min(cost for state in range(4) for _, cost, used, _ in edits(row, state) if used)


class Search:
    """Iterative-deepening A* over one stretch: ``rows``, what each state costs behind it, and whether turns may be inserted at
    its end (only where the conversation ends; elsewhere such insertions belong to the next stretch).

    ``failed`` is the transposition table: a state from which no path within the bound was found, with what the rest costs
    at least, so that it is entered again only with more left to spend. Searches from several starts share it.
    """

    def __init__(self, rows: list[str], behind: tuple[int, ...], last: bool):
        self.rows, self.behind, self.last = rows, behind, last
        self.need = [min(behind)]
        for row in reversed(rows):
            self.need.append(self.need[-1] + least(row))
        self.need.reverse()
        # the states from which any end is possible at all, from the end: else bounds would rise for ever
        self.open = [{s for s in range(4) if behind[s] < NEVER}]
        for at in range(len(rows), -1, -1):
            found = set(self.open[0]) if at == len(rows) else set()
            for _ in range(3):  # insertions stay at the same row
                found |= {s for s in range(4) for _, _, used, to in self.options(at, s) if to in (self.open[0] if used else found)}
            self.open[:0] = [found]
        self.open.pop()
        self.failed: dict[tuple[int, int], int] = {}

    def rest(self, at: int, state: int) -> int:
        return max(self.need[at], self.failed.get((at, state), 0)) if state in self.open[at] else NEVER

    def options(self, at: int, state: int) -> Iterator[Edit]:
        if at < len(self.rows):
            return edits(self.rows[at], state)
        return edits(None, state) if self.last else iter(())

    def within(self, bound: int, start: int) -> tuple[str, int] | None:
        """The first accepting path, depth first in ASCII order, that costs no more than ``bound``, and the state it ends in."""
        path: list[str] = []
        # of each state on the path: place, state, cost so far, edits not yet tried, what its rest costs at least
        frames = [[0, start, 0, self.options(0, start), self.behind[start] if not self.rows else NEVER]]
        if not self.rows and self.behind[start] <= bound:
            return "", start
        while frames:
            at, state, spent, left, low = frames[-1]
            for edit, cost, used, to in left:
                lower = cost + self.rest(at + used, to)
                if spent + lower > bound:
                    frames[-1][4] = min(frames[-1][4], lower)
                    continue
                path.append(edit)
                there = at + used
                end = self.behind[to] if there == len(self.rows) else NEVER
                if spent + cost + end <= bound:
                    return "".join(path), to
                frames.append([there, to, spent + cost, self.options(there, to), end])
                break
            else:
                self.failed[at, state] = frames.pop()[4]
                if frames:
                    edit = path.pop()
                    cost = spent - frames[-1][2]
                    frames[-1][4] = min(frames[-1][4], cost + self.failed[at, state])
        return None

    def cheapest(self, start: int) -> tuple[int, str, int]:
        """Cost with what lies behind, audit and end state; NEVER where no path is accepted."""
        bound = self.rest(0, start)
        while bound < NEVER:
            found = self.within(bound, start)
            if found:
                return bound, *found
            bound = self.rest(0, start)
        return NEVER, "", NOTHING


def rows_of(codes: str) -> list[str]:
    return [codes[i : i + 2] for i in range(0, len(codes), 2)]


END = tuple(0 if s in ACCEPTED else NEVER for s in range(4))


def costs(codes: str) -> list[int]:
    """From each state to each other, 4 by 4, over a stretch that is not the last."""
    found = [Search(rows_of(codes), tuple(0 if s == to else NEVER for s in range(4)), False) for to in range(4)]
    return [found[to].cheapest(start)[0] for start in range(4) for to in range(4)]


def follow(rows: list[str], audit: str, start: int) -> tuple[list[str], str]:
    """For each row what becomes of it: initials of the turns inserted before it, then = kept, - deleted, U or A the new role;
    and the initials of the turns inserted after the last row."""
    out, state, before, at = [], start, "", 0
    for edit in audit:
        role = FORCED[state]
        if edit == "I":
            before += role
        else:
            out.append(before + {"D": "-", "K": "=", "R": role.upper()}[edit])
            before = ""
            role = rows[at][0] if edit == "K" else role
            at += 1
        if edit != "D":
            state = NEXT[state][role]
    return out, before


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def conversations_of(df: DataFrame) -> DataFrame:
    """conv (the id as text, one space for null), turn, role and text (one space for null)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations_of`` with the damage that a checksum of ``conv:turn`` tells."""
    kind = F.crc32(F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.filter(kind != 0).select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def in_order(rows: DataFrame, bits: int = STRETCH_BITS) -> DataFrame:
    """``rows`` written once in order of turns, with their place in it and their stretch.

    Turns without a number come first; rows of a turn follow role and text. All rows are sorted by ranges, so a conversation
    of any length spreads over tasks.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(*order, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*order)
    return settle(ranged.withColumn("pos", F.monotonically_increasing_id()).withColumn("stretch", F.shiftright("pos", bits)), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows of ``in_order`` with their first fault: B blank, D duplicate (role and text seen earlier), T truncated, - none."""
    firsts = rows.groupBy("conv", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    said = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    slim = rows.select("pos", "conv", "turn", "stretch", initial(F.col("role")).alias("initial"), (said == "").alias("_blank"), F.substring(said, -1, 1).isin(".", "!", "?").alias("_ended"))
    fault = F.when(F.col("_blank"), "B").when(F.col("_first").isNull(), "D").when(F.col("_ended"), "-").otherwise("T")
    return slim.join(firsts, "pos", "left").select("pos", "conv", "turn", "stretch", "initial", fault.alias("fault"))


COSTS = "conv string, stretch long, codes string, costs array<long>"
BEHIND = "conv string, stretch long, codes string, last boolean, behind array<long>"
FOUND = "conv string, stretch long, codes string, audits array<string>, ends array<int>"
PICKED = "conv string, stretch long, audit string, cost long, illegal long, fates array<string>, after string"


def look_back(behind: tuple[int, ...] | None, row: dict) -> tuple[tuple[int, ...], dict]:
    """From the last stretch to the first: what each state costs behind a stretch, and so before it."""
    last = behind is None
    behind = END if last else behind
    if last:
        search = Search(rows_of(row["codes"]), END, True)
        before = tuple(search.cheapest(s)[0] for s in range(4))
    else:
        before = tuple(min(NEVER, *(int(row["costs"][4 * s + to]) + behind[to] for to in range(4))) for s in range(4))
    return before, {**row, "last": last, "behind": list(behind)}


def searched(row: dict) -> dict:
    """The audits of a stretch from each state in which it may begin; a whole conversation begins with nothing."""
    search = Search(rows_of(row["codes"]), tuple(int(x) for x in row["behind"]), bool(row["last"]))
    found = [search.cheapest(s) for s in range(4 if row["several"] else 1)]
    return {**row, "audits": [f[1] for f in found], "ends": [f[2] for f in found]}


def look_forward(state: tuple[int, str] | None, row: dict) -> tuple[tuple[int, str], dict]:
    """From the first stretch to the last: the audit that goes on from the state in which the one before ended."""
    start, before = state or (NOTHING, "")
    rows, audit = rows_of(row["codes"]), row["audits"][start]
    roles = before + "".join(r[0] for r in rows)
    illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
    fates, after = follow(rows, audit, start)
    cost = sum({"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[e] for e in audit) + TRUNCATED * sum(r[1] == "T" and f[-1] != "-" for r, f in zip(rows, fates, strict=True))
    return (int(row["ends"][start]), roles[-1]), {"conv": row["conv"], "stretch": row["stretch"], "audit": audit, "cost": cost, "illegal": illegal, "fates": fates, "after": after}


def audits(codes: DataFrame) -> DataFrame:
    """From settled ``with_faults``: for each stretch of each conversation its part of the audit and what becomes of its rows."""
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("initial", "fault").alias("code")))), lambda x: x.code), "")
    stretches = settle(codes.groupBy("conv", "stretch").agg(code.alias("codes")), "stretches")
    several = stretches.groupBy("conv").agg((F.count(F.lit(1)) > 1).alias("several"))
    cut = stretches.join(several, "conv")
    alone = cut.filter("not several").select("conv", "stretch", "codes", F.lit(True).alias("last"), F.array(*[F.lit(x).cast("long") for x in END]).alias("behind"), F.lit(False).alias("several"))
    weighed = each(cut.filter("several").drop("several"), lambda row: {**row, "costs": costs(row["codes"])}, COSTS)
    joined = scan(weighed, "conv", [F.col("stretch").desc()], look_back, BEHIND).withColumn("several", F.lit(True))
    found = each(alone.unionByName(joined), searched, FOUND)
    return settle(scan(found, "conv", [F.col("stretch").asc()], look_forward, PICKED), "audits")


def repaired(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv, pos, nth, role, text, in order of pos and nth within a conversation."""
    turns = "array<struct<role:string,text:string>>"
    name = lambda c: F.when(F.lower(c) == "u", "user").otherwise("assistant")
    new = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.struct(name(c).alias("role"), F.lit("").alias("text"))).cast(turns)
    place = F.row_number().over(W.partitionBy("conv", "stretch").orderBy("pos"))
    dealt = rows.withColumn("_k", place).join(picked.select("conv", "stretch", "fates"), ["conv", "stretch"]).withColumn("_fate", F.element_at("fates", F.col("_k")))
    end = F.substring("_fate", -1, 1)
    own = F.array(F.struct(F.when(end == "=", F.col("role")).otherwise(name(end)).alias("role"), F.col("text").alias("text"))).cast(turns)
    kept = F.when(end == "-", F.array().cast(turns)).otherwise(own)
    out = dealt.select("conv", "pos", F.posexplode(F.concat(new(F.expr("substring(_fate, 1, length(_fate) - 1)")), kept)).alias("nth", "t"))
    tail = picked.filter("after <> ''").select("conv", F.lit((1 << 63) - 1).alias("pos"), F.posexplode(new(F.col("after"))).alias("nth", "t"))
    return out.unionByName(tail).select("conv", "pos", "nth", "t.role", "t.text")


def digest(state, row: dict):
    """SHA-256 over a conversation's turns as ``role:text``, joined by line ends."""
    sha = state or hashlib.sha256()
    sha.update((("\n" if state else "") + row["role"] + ":" + row["text"]).encode())
    return sha, None


def repair(rows: DataFrame, bits: int = STRETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """Judge and repair rows of ``conversations_of``: a row for each conversation that has rows, and the turns of ``repaired``.

    conv, gaps (numbers missing between the turns; 0 where no turn has one), blank, duplicate, truncated, illegal, cost and
    audit. Nulls of role and text are one space; rows equal in all are duplicates of the first; an empty table gives no rows;
    very long texts stay in their rows.
    """
    ordered = in_order(rows, bits)
    codes = settle(with_faults(ordered), "faults")
    picked = audits(codes)
    numbers = codes.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == x).alias(x) for x in "BDT"])
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = F.coalesce((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).try_cast("long"), F.lit(0))
    faults = numbers.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(x).alias(name) for x, name in zip("BDT", ("blank", "duplicate", "truncated"), strict=True)])
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "audit"))), lambda x: x.audit), "")
    cost = picked.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    return faults.join(cost, "conv"), repaired(ordered, picked)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    judged, turns = repair(damaged(conversations_of(given)))
    said = scan(turns, "conv", [F.col("pos").asc(), F.col("nth").asc()], digest, "conv string, repaired_sha256 string", lambda conv, sha: {"conv": conv, "repaired_sha256": sha.hexdigest()})
    ids = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(judged, "conv", "left").join(said, "conv", "left")
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by a walk over places: of the states 0 to 3 the least string of cost (six digits), audit, chr(1) and repaired text."""

    def plus(state: str, cost: str, edit: str, line: str | None = None) -> str:
        head, text = f"split_part({state}, chr(1), 1)", f"substr({state}, strpos({state}, chr(1)) + 1)"
        return f"lpad((left({state}, 6)::BIGINT + {cost})::VARCHAR, 6, '0') || substr({head}, 7) || '{edit}' || chr(1) || {text}" + (f" || {line} || chr(10)" if line else "")

    insert = {s: plus(f"b{s}", str(INSERT), "I", "'assistant:'" if s == USER else "'user:'") for s in range(4)}
    twice = {s: plus(f"({insert[s]})", str(INSERT), "I", "'assistant:'") for s in (NOTHING, SYSTEM)}
    closed = f"""b0 AS e0, b1 AS e1, least(b2, {insert[0]}, {insert[1]}, {insert[3]}) AS e2, least(b3, {insert[2]}, {twice[0]}, {twice[1]}) AS e3"""
    more = f"(CASE WHEN fault = 'T' THEN {TRUNCATED} ELSE 0 END)"

    def taken(to: int, role: str, letter: str, *states: int) -> str:
        kept = ", ".join(f"CASE WHEN fault NOT IN ('B', 'D') AND left(role, 1) = '{letter}' THEN {plus(f'e{s}', more, 'K', 'role || chr(58) || text')} END" for s in states)
        new = "" if letter == "s" else ", " + ", ".join(f"CASE WHEN fault NOT IN ('B', 'D') THEN {plus(f'e{s}', f'{REROLE} + {more}', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END" for s in states)
        return f"least({plus(f'e{to}', str(DELETE), 'D')}, {kept}{new}) AS b{to}"

    step = ", ".join([f"{plus('e0', str(DELETE), 'D')} AS b0", taken(1, "system", "s", 0), taken(2, "user", "u", 0, 1, 3), taken(3, "assistant", "a", 2)])
    return f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
summed AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 20 AS kind FROM given),
hurt AS (
    SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM summed, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'B'
        WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'D'
        WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN ('.', '!', '?') THEN '-' ELSE 'T' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair FROM placed),
counted AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
        count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv),
walk AS (
    SELECT conv, 0::BIGINT AS i, '000000' || chr(1) AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM counted
    UNION ALL
    SELECT conv, i, {step} FROM (SELECT w.conv, r.i, r.role, r.text, r.fault, {closed} FROM walk w JOIN judged r ON r.conv = w.conv AND r.i = w.i + 1)),
ended AS (SELECT w.conv, least(e0, e3) AS best FROM (SELECT conv, i, {closed} FROM walk) w JOIN counted c ON c.conv = w.conv AND c.n = w.i),
told AS (SELECT conv, left(best, 6)::BIGINT AS cost, substr(split_part(best, chr(1), 1), 7) AS audit, substr(best, strpos(best, chr(1)) + 1) AS repaired FROM ended)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(repaired, greatest(length(repaired) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) d LEFT JOIN counted c ON c.conv = d.conv LEFT JOIN told t ON t.conv = d.conv
"""


OP12_SQL = _oracle()
