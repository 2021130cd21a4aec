"""Conversation structure repair by depth-first branch and bound.

A conversation's turns are kept, given another role, deleted, or joined by inserted ones, so that the roles
become `(s?(ua)+)?` at the least cost; of equal costs the least audit (the edits' letters in order) wins.

The search goes through prefixes of edits with a stack of its own, in the order of their letters.  A prefix is left
when its cost and the bound of its rest exceed the incumbent, or when its node (rows done, grammar state) was reached
as cheaply before: such an arrival has the lesser audit, as the order of the search is that of audits.  A bound is the
rest's cost if a conversation may end in any state; ending rightly takes two inserted turns at most, so no node is
entered for more than a few costs and the time grows with the number of rows.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm.common import SPACE, dealt_anew

DELETE, RENAME, INSERT = 3, 2, 2
TRUNCATED = 1
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (True, False, False, True)
#: The state that a turn with the initial leads to, and the one that a turn made for the state leads to.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_MADE = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A row's code: its initial's number, times 3, and whether it may stay, must go or is truncated.
_INITIALS = "sua"
SOUND, GOES, CUT_OFF = range(3)
_FAR = 1 << 30
_BLANK, _TRUNCATED = "blank", "truncated"


def row_code(initial: str, fault: int) -> int:
    return 3 * (_INITIALS.find(initial) if initial and initial in _INITIALS else 3) + fault


def _steps(code: int, state: int):
    """(letter, cost, state) of the edits that take a row with the code, in the order of their letters."""
    kind, fault = divmod(code, 3)
    yield "D", DELETE, state
    if fault != GOES:
        more = TRUNCATED if fault == CUT_OFF else 0
        if kind < 3 and (then := _KEPT[state].get(_INITIALS[kind])) is not None:
            yield "K", more, then
        yield "R", RENAME + more, _MADE[state]


#: For each code and state: the edits that take a row.
_TAKES = [[tuple(_steps(code, state)) for state in range(4)] for code in range(12)]


def suffix_bounds(codes: bytes) -> array:
    """At 4 * i + state: the least cost of the rows from i on, if they may end in any state."""
    n = len(codes)
    low = array("q", [0]) * (4 * n + 4)
    for i in range(n - 1, -1, -1):
        here = [min(cost + low[4 * i + 4 + then] for _, cost, then in steps) for steps in _TAKES[codes[i]]]
        for _ in range(2):  # two inserted turns lead to every state that inserting can lead to
            here = [min(here[s], INSERT + here[_MADE[s]]) for s in range(4)]
        low[4 * i : 4 * i + 4] = array("q", here)
    return low


def _dive(codes: bytes, low: array) -> tuple[int, str]:
    """A first incumbent: at each node the edit with the least bound."""
    i, state, cost, letters = 0, START, 0, []
    while i < len(codes) or not _ENDS[state]:
        ways = [(INSERT + low[4 * i + _MADE[state]], "I", INSERT, _MADE[state], i)]
        if i < len(codes):
            ways += [(c + low[4 * i + 4 + then], letter, c, then, i + 1) for letter, c, then in _TAKES[codes[i]][state]]
        _, letter, more, state, i = min(ways)
        cost += more
        letters.append(letter)
    return cost, "".join(letters)


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows with these codes, ties by the least audit."""
    n, low = len(codes), suffix_bounds(codes)
    incumbent = _dive(codes, low)
    limit = incumbent[0]
    reached = array("q", [_FAR]) * (4 * n + 4)  # the least cost of each node so far
    letters, before = bytearray(), array("q")  # of the prefixes entered: last letter, and the prefix without it
    stack = [(0, START, 0, -1, "")]
    while stack:
        i, state, cost, prefix, letter = stack.pop()
        if cost + low[4 * i + state] > limit or reached[4 * i + state] <= cost:
            continue
        reached[4 * i + state] = cost
        if letter:
            letters.append(ord(letter))
            before.append(prefix)
            prefix = len(before) - 1
        if i == n and _ENDS[state]:
            audit, at = bytearray(), prefix
            while at >= 0:
                audit.append(letters[at])
                at = before[at]
            incumbent = min(incumbent, (cost, audit[::-1].decode()))
            limit = cost - 1  # what comes later at this cost has a greater audit
        ways = [("I", INSERT, _MADE[state], i)]
        if i < n:
            ways += [(x, more, then, i + 1) for x, more, then in _TAKES[codes[i]][state]]
        for x, more, then, at in sorted(ways, reverse=True):
            if cost + more + low[4 * at + then] <= limit and reached[4 * at + then] > cost + more:
                stack.append((at, then, cost + more, prefix, x))
    return incumbent


def _keyed(turns: DataFrame) -> DataFrame:
    """The turns without nulls in role and text, and a key of both."""
    t = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return t.withColumn("key", F.unhex(F.sha2(whole, 256)))


def _fault(text: Column) -> Column:
    blank = ~text.rlike(r"[^" + SPACE[1:])
    return F.when(blank, _BLANK).when(~text.rlike(r"[.!?]" + SPACE + r"*\z"), _TRUNCATED).otherwise("")


_PLAN = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _planned(batches):
    """Plans of conversations whose rows come one after the other; a byte is held for each row of one conversation."""
    names = [c.split(" ")[0] for c in _PLAN.split(", ")]
    conv, codes, out = None, None, []

    def close():
        gap = 0 if least is None else min(2**63 - 1, most - least + 1 - distinct)
        out.append((conv, len(codes), gap, *faults, illegal, *cheapest(bytes(codes))))

    def batch(rows):
        types = [pa.string() if c == "audit" else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for c, turn, initial, fault, repeats, n in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if codes is None or c != conv:
                if codes is not None:
                    close()
                conv, codes, faults, illegal, last = c, bytearray(), [0, 0, 0], 0, None
                least = most = None
                distinct = 0
            if turn is not None and turn != most:
                least, most, distinct = turn if least is None else least, turn, distinct + 1
            for k in range(n):
                repeated = k >= n - repeats
                which = 0 if fault == _BLANK else 1 if repeated else 2 if fault == _TRUNCATED else None
                if which is not None:
                    faults[which] += 1
                codes.append(row_code(initial, SOUND if which is None else CUT_OFF if which == 2 else GOES))
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
        if len(out) >= 1000:
            yield batch(out)
            out.clear()
    if codes is not None:
        close()
    if out:
        yield batch(out)


def repair_plans(turns: DataFrame) -> DataFrame:
    """A row for each conv_id of turns (conv_id, turn, role, text; others are left aside): its faults, and the cheapest repair.

    n_rows; gaps (missing numbers between the least and the greatest turn); rows that are blank, else repeat a role and
    text seen earlier, else are truncated (last character other than white space not one of .!?); illegal, adjacent roles
    whose initials are not su, ua or au; cost and audit of the repair (letters K keep, R give a role, D delete, I insert).
    Rows go by turn, null first, ties by role and a hash of the text; equal rows follow each other.  A null role or text
    counts as one space.  Rows without a conv_id are one conversation.  An empty table gives no rows.  Very long texts are
    only hashed; of a conversation of any length a byte a row is held.
    """
    of_row = ["conv_id", "turn", "role", "key", F.substring("role", 1, 1).alias("initial"), _fault(F.col("text")).alias("fault")]
    rows = _keyed(turns).select(*of_row).groupBy("conv_id", "turn", "role", "key", "initial", "fault").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.groupBy(F.col("conv_id").alias("of"), F.col("key").alias("same")).agg(F.min(place).alias("first"))
    first = first.select("of", dealt_anew("same"), "first")
    seen = rows.withColumn("key", dealt_anew("key")).join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same")))
    repeats = F.when(place.eqNullSafe(F.col("first")), F.col("n") - 1).otherwise(F.col("n"))
    ordered = seen.withColumn("repeats", repeats).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "key")
    return ordered.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "initial", "fault", "repeats", "n").mapInArrow(_planned, _PLAN)


_REPAIRED = "conv_id long, position long, edit string, turn long, role string, text string"


def _applied(batches):
    """Repaired rows of conversations, each of which comes as its audit and then its rows in order."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in _REPAIRED.split(", ")]
    out: list[tuple] = []
    size = 0
    conv, audit, at, state, position = None, "", 0, START, 0

    def put(edit, turn, role, text):
        nonlocal position, size
        out.append((conv, position, edit, turn, role, text))
        position, size = position + 1, size + len(text)

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _MADE[state]
            put("I", None, _ROLE[state], "")

    def batch():
        nonlocal size
        rows = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        size = 0
        return pa.RecordBatch.from_arrays(rows, names=names)

    for b in batches:
        for c, plan, turn, role, text in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if plan is not None:
                inserts()
                conv, audit, at, state, position = c, plan, 0, START, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = _KEPT[state][role[0]]
                put(edit, turn, role, text)
            elif edit == "R":
                state = _MADE[state]
                put(edit, turn, _ROLE[state], text)
            if size > 16_000_000 or len(out) >= 5000:
                yield batch()
    inserts()
    if out:
        yield batch()


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns after the edits of repair_plans(turns): (conv_id, position, edit, turn, role, text), inserted ones without a turn.

    A conversation's rows follow each other in one partition, in the order of positions, and stream through it: none is
    held whole.  Nulls, ties, repeated rows and empty tables are as in repair_plans; deleted rows are left out.
    """
    rows = _keyed(turns).select(F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long"), "role", "text", "key")
    head = plans.select(F.col("conv_id").cast("long"), F.lit(0).alias("kind"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "binary"))])
    ordered = head.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "key")
    return ordered.select("conv_id", "audit", "turn", "role", "text").mapInArrow(_applied, _REPAIRED)


def _digested(batches):
    conv, h, found = None, None, []
    for b in batches:
        for c, role, text in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if h is None or c != conv:
                if h is not None:
                    found.append((conv, h.hexdigest()))
                conv, h = c, hashlib.sha256(f"{role}:{text}".encode())
            else:
                h.update(f"\n{role}:{text}".encode())
        if len(found) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pa.array([c for c, _ in found], pa.int64()), [d for _, d in found])], names=["conv_id", "repaired_sha256"])
            found.clear()
    if h is not None:
        found.append((conv, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([d for _, d in found])], names=["conv_id", "repaired_sha256"])


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired(): SHA-256 of a conversation's `role:text`, joined by newlines."""
    return rows.select("conv_id", "role", "text").mapInArrow(_digested, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with faults that a hash of `conv_id:turn` chooses; nulls are one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes out .!?, 3 repeats it and 4 makes it a user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    d = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(True), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = damaged(conversations)
    plans = repair_plans(turns)
    ids = conversations.select("conv_id").distinct()
    whole = ids.join(plans.withColumnRenamed("conv_id", "_p"), F.col("conv_id").eqNullSafe(F.col("_p")), "left")
    whole = whole.join(digests(repaired(turns, plans)).withColumnRenamed("conv_id", "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string: bit by bit, as DuckDB has no function for it."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


# A state of the recursion is the least string of cost (10 digits), audit and repaired rows for each grammar state
# (z nothing yet, s, u, a): cost first, then audit, which char 1 ends.  Inserting leads from z, s and a to u, and from u to a.
_WITH = "lpad(({x}[1:10]::BIGINT + {cost})::VARCHAR, 10, '0') || split_part({x}[11:], chr(1), 1) || '{letter}' || chr(1) || {x}[length(split_part({x}[11:], chr(1), 1)) + 12:]{more}"


def _sql_move(x: str, cost: str, letter: str, line: str | None) -> str:
    more = "" if line is None else f" || {line} || chr(2)"
    return _WITH.format(x=x, cost=cost, letter=letter, more=more)


def _sql_inserted(source: str) -> str:
    """The four states after any insertions."""
    ins = lambda x, role: _sql_move(x, "2", "I", f"'{role}:'")
    one = f"SELECT * REPLACE (least(u, {ins('z', 'user')}, {ins('s', 'user')}, {ins('a', 'user')}) AS u, least(a, {ins('u', 'assistant')}) AS a) FROM {source}"
    return f"SELECT * REPLACE (least(u, {ins('z', 'user')}, {ins('s', 'user')}, {ins('a', 'user')}) AS u, least(a, {ins('u', 'assistant')}) AS a) FROM ({one})"


def _sql_row() -> str:
    own, made = "r.role || ':' || r.text", "'{}:' || r.text"
    t = "r.cut"
    gone = lambda x: _sql_move(x, "3", "D", None)
    keep = lambda x, initial: f"CASE WHEN NOT r.goes AND left(r.role, 1) = '{initial}' THEN {_sql_move(x, t, 'K', own)} END"
    give = lambda x, role: f"CASE WHEN NOT r.goes THEN {_sql_move(x, '2 + ' + t, 'R', made.format(role))} END"
    to_user = ", ".join(f"{keep(x, 'u')}, {give(x, 'user')}" for x in "zsa")
    return f"{gone('z')} AS z, least({gone('s')}, {keep('z', 's')}) AS s, least({gone('u')}, {to_user}) AS u, least({gone('a')}, {keep('u', 'a')}, {give('u', 'assistant')}) AS a"


OP11_SQL = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))
  FROM kinds WHERE kind <> 0),
told AS (SELECT *, row_number() OVER () AS id FROM hurt),
placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) AS seen,
    left(lag(role) OVER w, 1) || left(role, 1) AS two, lag(role) OVER w AS prior,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
  FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), id)),
faults AS (SELECT *, blank OR seen > 1 AS goes, (open AND NOT blank AND seen = 1)::BIGINT AS cut FROM placed),
best AS (
  SELECT conv_id, 0 AS i, repeat('0', 10) || chr(1) AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM hurt)
  UNION ALL
  SELECT r.conv_id, r.i, {_sql_row()} FROM ({_sql_inserted("best")}) b JOIN faults r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1),
ended AS (
  SELECT conv_id, least(z, a) AS x FROM ({_sql_inserted("(SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)")})),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND seen > 1) AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (prior IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(x[1:10]::BIGINT, 0) AS cost, coalesce(split_part(x[11:], chr(1), 1), '') AS audit,
  sha256(replace(coalesce(rtrim(x[length(split_part(x[11:], chr(1), 1)) + 12:], chr(2)), ''), chr(2), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
