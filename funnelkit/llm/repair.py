"""Operator 13: conversation structure repair by Knuth's lightest derivation.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. Rows are kept (at
no cost), given the role user or assistant (3), deleted (4; blank rows and repeats have
to be), and empty user or assistant rows are put in between (3 each); a truncated row
that stays adds 3. Of all edits the cheapest are taken, ties by the least audit, the
string of the edits' initials.

The repair is a weighted deduction. Items are ``(rows consumed, state)``, where the state
is what the roles so far allow next; the deductions that lead from an item (keep,
rerole, delete the next row, insert one) weigh ``(cost, audit)``, adding to the cost and
appending to the audit. That function is superior (it never makes an item lighter) and
monotone: audits of one item at one cost are never the beginning of each other, as the
same beginning costs the same and a further insert costs more. So items popped from an
agenda in the order of their weights are final, each by its lightest derivation, until
the goal item is. Every item has one antecedent besides the row itself, so hyperedges
are edges with a constant.

Spark does the rest. Damage, faults and repeats are DataFrame expressions; a repeat is
found by the first turn of its (conversation, role, text hash), which is an aggregate
joined back, so a text that a third of all rows share is one row. Rows without their
texts are range-partitioned by (conversation, turn) and become a symbol each, a letter
for role class and fault: a conversation that holds a third of all rows is written down
by many tasks, in pieces. Pieces of a conversation meet as one string, as long as its
audit, which is a cell of the result anyway. The agenda works through a string in
windows of ``WINDOW`` rows; the items at a window's end go on into the next with audits
shortened to what still tells them apart. At last rows and audit meet in order of turn,
and the repaired text goes into the digest as it streams past, in bounded memory. That
last pass of one conversation is sequential, as the digest of one text is.

Rows are told by ``conv_id`` and ``turn``; a null of either, of a role or a text counts
as one space where it is read as text. Rows of one turn follow each other by role, then
by a hash of the text (so equal rows are adjacent, and repeats of each other). Roles are
judged by their first character, an empty one is none. A null ``conv_id`` is a
conversation like any other. Other columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from funnelkit.llm.quality import SPACE
from funnelkit.llm.tables import written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WINDOW = 256               # rows that one agenda works through
PIECE = 1 << 20            # letters of one piece of a conversation
FAULTS = ("", "blank", "duplicate", "truncated")
# What may follow: nothing yet, a system row, a user row, an assistant row. The last
# states of a repaired conversation are the first (nothing is left) and the last.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
STATES, FINAL = ("", "s", "u", "a"), ("", "a")
ROLES = {"u": "user", "a": "assistant"}


def symbol(kind: str, fault: str) -> str:
    """The letter of a row: its role class (``s``, ``u``, ``a`` or other) and its fault."""
    return chr(ord("A") + 4 * "suax".index(kind) + FAULTS.index(fault))


SYMBOLS = {symbol(k, f): (k, f) for k in "suax" for f in FAULTS}


def _edits(letter: str) -> dict[str, list[tuple[int, str, str]]]:
    """For each state the ``(cost, initial, next state)`` of what can be done with a row."""
    kind, fault = SYMBOLS[letter]
    out = {}
    for state in STATES:
        found = [(DELETE, "D", state)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if (state, kind) in NEXT:
                found.append((more, "K", NEXT[state, kind]))
            found += [(more + REROLE, "R", NEXT[state, c]) for c in ROLES if c != kind and (state, c) in NEXT]
        out[state] = found
    return out


EDITS = {letter: _edits(letter) for letter in SYMBOLS}
INSERTS = {state: [(INSERT, "I", NEXT[state, c]) for c in ROLES if (state, c) in NEXT] for state in STATES}


def agenda(letters: str, start: dict[str, tuple[int, str]], last: bool) -> dict[str, tuple[int, str, str]]:
    """Lightest derivations of the items after all rows: state to (cost, audit, state it
    started from). ``start`` holds the items before the first row with their weights. With
    ``last`` the first final state is the goal, and ends it."""
    waiting = [(cost, audit, 0, state, state) for state, (cost, audit) in start.items()]
    heapq.heapify(waiting)
    done, ends, n = set(), {}, len(letters)
    while waiting and len(ends) < len(STATES):
        cost, audit, at, state, origin = heapq.heappop(waiting)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n:
            ends[state] = (cost, audit, origin)
            if last and state in FINAL:
                return {state: ends[state]}
        else:
            for more, letter, after in EDITS[letters[at]][state]:
                if (at + 1, after) not in done:
                    heapq.heappush(waiting, (cost + more, audit + letter, at + 1, after, origin))
        for more, letter, after in INSERTS[state]:
            if (at, after) not in done:
                heapq.heappush(waiting, (cost + more, audit + letter, at, after, origin))
    return ends


def shortened(audits: dict[str, str]) -> dict[str, str]:
    """Audits that compare with each other, whatever is appended, as the given ones do:
    letters that all share go, and so do those after an audit differs from all others."""
    if len(audits) == 1:
        return dict.fromkeys(audits, "")
    values = list(audits.values())
    least, most = min(values), max(values)
    same = next((i for i, (a, b) in enumerate(zip(least, most)) if a != b), len(least))
    rest = {s: a[same:] for s, a in audits.items()}
    if "" in rest.values():        # one begins the others: what they add is inserts, and counts
        return rest
    out = {}
    for letter in {a[0] for a in rest.values()}:
        out |= {s: letter + a for s, a in shortened({s: a[1:] for s, a in rest.items() if a[0] == letter}).items()}
    return out


def repair(letters: str, window: int = WINDOW) -> tuple[int, str]:
    """Cost and audit of a conversation's cheapest edits."""
    state, base, trail = {"": (0, "")}, 0, []
    edges = list(range(window, len(letters), window))
    for a, b in zip([0, *edges], [*edges, len(letters)]):
        ends = agenda(letters[a:b], state, b == len(letters))
        trail.append({s: (audit[len(state[origin][1]):], origin) for s, (_, audit, origin) in ends.items()})
        least = min(cost for cost, _, _ in ends.values())
        short = shortened({s: audit for s, (_, audit, _) in ends.items()})
        state = {s: (cost - least, short[s]) for s, (cost, _, _) in ends.items()}
        base += least
    (at,) = state                                          # the goal
    audit = []
    for step in reversed(trail):
        letters_, at = step[at]
        audit.append(letters_)
    return base, "".join(reversed(audit))


def figures(letters: str) -> dict[str, int]:
    """Rows by fault, and neighbours whose roles may not follow each other."""
    out = {f: sum(letters.count(symbol(k, f)) for k in "suax") for f in FAULTS if f}
    kinds = letters.translate(KINDS)
    good = sum(kinds.count(x) for x in ("su", "ua", "au"))     # none of them overlaps itself
    return out | {"illegal": max(0, len(kinds) - 1) - good}


KINDS = str.maketrans({letter: k for letter, (k, _) in SYMBOLS.items()})


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``k, conv, turn, role, text, times`` after the damage, which the hash of
    ``conv:turn`` picks; a dropped row has ``times`` 0, a repeated one 2."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    own = df.select(F.col(conv).alias("k"), plain(conv).alias("conv"), F.col(turn).alias("turn"),
                    plain(role).alias("role"), plain(text).alias("text"), kind.alias("kind"))
    return own.select(
        "k", "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


ORDER = ["conv", "turn", "role", "h", "i"]  # nulls of turn first
HASHED = {"h": F.xxhash64, "i": lambda c: F.xxhash64(F.lit(1), c)}


def hashed(rows: DataFrame) -> DataFrame:
    """With 128 bits of hash of the text."""
    return rows.withColumns({n: f(F.col("text")) for n, f in HASHED.items()})


def _letter() -> Column:
    """The row's symbol without repeats, which ``_pieces`` tells."""
    bare = F.btrim("text", F.lit(SPACE))
    kind = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    kind = F.when((F.col("role") == "") | (kind == 0), 3).otherwise(kind - 1)
    fault = F.when(bare == "", FAULTS.index("blank")) \
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), FAULTS.index("truncated")).otherwise(0)
    return F.char(ord("A") + 4 * kind + fault)


PIECES = "conv string, part int, piece int, letters string, low bigint, high bigint, turns bigint"
FOUND = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string"}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _pieces(schema: pa.Schema):
    """Strings of symbols from rows in order, with the turns they span. A row is a repeat
    if it is not at the first turn of its kind (``later``) or equals the row before."""
    repeat = {x: x if f == "blank" else symbol(k, "duplicate") for x, (k, f) in SYMBOLS.items()}

    def work(batches):
        now, row, piece, letters, size, low, high, turns = None, None, 0, [], 0, None, None, 0
        done = []
        for batch in batches:
            for k, conv, turn, role, h, i, times, letter, later, part in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now[1] or size >= PIECE:
                    if now is not None:
                        done.append((*now, piece, "".join(letters), low, high, turns))
                    if now is None or conv != now[1]:
                        row = None
                    now, piece, letters, size, low, high, turns = (k, conv, part), piece + 1, [], 0, None, None, 0
                if not times:
                    continue
                if turn is not None and (turns == 0 or turn != high):
                    low, high, turns = turn if turns == 0 else low, turn, turns + 1
                again = later or row == (turn, role, h, i)
                row = (turn, role, h, i)
                letters.append((repeat[letter] if again else letter) + repeat[letter] * (times - 1))
                size += times
            if done:
                yield _batch(done, schema)
                done = []
        if now is not None:
            yield _batch([(*now, piece, "".join(letters), low, high, turns)], schema)
    return work


def _repaired(schema: pa.Schema):
    """A conversation's figures, cost and audit from its pieces in order."""
    def work(batches):
        for batch in batches:
            done = []
            for k, conv, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                letters = "".join(p["letters"] for p in pieces)
                spans = [(p["low"], p["high"], p["turns"]) for p in pieces if p["turns"]]
                gaps = 0
                if spans:
                    turns = sum(t for _, _, t in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
                    gaps = min(spans[-1][1] - spans[0][0] + 1 - turns, (1 << 63) - 1)
                found = figures(letters)
                cost, audit = repair(letters)
                done.append((k, conv, gaps, found["blank"], found["duplicate"], found["truncated"], found["illegal"],
                             cost, audit))
            yield _batch(done, schema)
    return work


class Repaired:
    """The digest of a conversation's repaired rows, fed in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.rows = audit, 0, "", hashlib.sha256(), 0

    def _line(self, initial: str, role: str, text: str) -> None:
        self.state = NEXT[self.state, initial]
        line = f"{role}:{text}" if self.rows == 0 else f"\n{role}:{text}"
        self.digest.update(line.encode("utf-8", "surrogatepass"))
        self.rows += 1

    def _next(self) -> str:
        """The initial of the user or assistant row that may stand here."""
        return "a" if self.state == "u" else "u"

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(self._next(), ROLES[self._next()], "")
            self.at += 1

    def row(self, role: str, text: str, times: int) -> None:
        self.inserts()
        edit = self.audit[self.at]
        if edit == "K":
            self._line(role[0], role, text)
        elif edit == "R":
            self._line(self._next(), ROLES[self._next()], text)
        self.at += 1
        for _ in range(times - 1):      # repeats, which are deleted
            self.inserts()
            self.at += 1

    def hexdigest(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def _digests(facts: list[str], schema: pa.Schema):
    """Audit rows come before their conversation's rows, which stream past."""
    def work(batches):
        now, fact = None, None
        for batch in batches:
            done = []
            column = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
            every = zip(column("audit"), column("role"), column("text"), column("times"), zip(*map(column, facts)))
            for audit, role, text, times, found in every:
                if audit is not None:
                    if now is not None:
                        done.append((*fact, now.hexdigest()))
                    now, fact = Repaired(audit), found
                else:
                    now.row(role, text, times)
            if done:
                yield _batch(done, schema)
        if now is not None:
            yield _batch([(*fact, now.hexdigest())], schema)
    return work


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256`` of every conversation, after the damage."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = hashed(damaged(df, conv, turn, role, text))
    kind = rows.schema["k"].dataType
    key = pa.field("k", to_arrow_type(kind))
    slim = rows.select("k", *ORDER, "times", _letter().alias("letter"))
    same = ["conv", "role", "h", "i"]
    # the first turn of a kind of row: null if any is, as nulls come first
    repeats = slim.where("times > 0").groupBy(*same).agg(
        F.count("*").alias("n"), F.min("turn").alias("least"), F.count("turn").alias("known")) \
        .where("n > 1").select(*same, F.lit(True).alias("seen"), F.when(F.col("known") == F.col("n"), F.col("least")).alias("first"))
    later = F.col("seen").isNotNull() & ~F.col("first").eqNullSafe(F.col("turn"))
    ordered = slim.join(repeats, same, "left").select("k", *ORDER, "times", "letter", later.alias("later")) \
        .repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    arrow = pa.schema([key, ("conv", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("letters", pa.string()),
                       ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])
    pieces = ordered.mapInArrow(_pieces(arrow), f"k {kind.simpleString()}, {PIECES}")
    # as many tasks as there are partitions: the agendas are the work, their strings are small
    whole = pieces.repartition(parts, "conv").groupBy("k", "conv").agg(F.sort_array(F.collect_list(F.struct(
        "part", "piece", "letters", "low", "high", "turns"))).alias("pieces"))
    arrow = pa.schema([key, ("conv", pa.string()), *((n, pa.int64()) for n in list(FOUND)[:-1]), ("audit", pa.string())])
    found = written(whole.mapInArrow(_repaired(arrow), f"k {kind.simpleString()}, conv string, "
                                     + ", ".join(f"{n} {t}" for n, t in FOUND.items())), "audits")
    # an audit and the rows it is about, in order
    met = found.unionByName(rows.where("times > 0").drop("k"), allowMissingColumns=True) \
        .repartition(parts, "conv").sortWithinPartitions("conv", F.col("audit").isNull(), *ORDER[1:])
    facts = ["k", *FOUND]
    arrow = arrow.remove(1).append(pa.field("sha", pa.string()))
    out = met.mapInArrow(_digests(facts, arrow), f"k {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in FOUND.items())
                         + ", sha string")
    return out.select(F.col("k").alias("conv_id"), *FOUND, F.col("sha").alias("repaired_sha256"))
