"""Conversations whose roles alternate, by the cheapest edits of what is there.

The edits of a conversation are the paths of a lattice: a node for each place between its rows
and each state of the wanted pattern of roles, an arc for each edit, with an integer cost. The
auction algorithm finds shortest paths in it: a path grows from its origin to the arc that is
cheapest by the nodes' prices, and where the last node's price is below what every arc from it
asks, the price rises and the path loses the node. Prices never exceed the true distances, and
nodes on a path that has arrived have them exactly. Then the tight arcs (price equal to cost and
next price) lead along all cheapest ways, and taking the first letter of the alphabet at each
gives the least sequence of edits.

A long conversation is cut into pieces. Of each piece the auction gives the distances from every
state before it to every state after it; these are the arcs of a lattice of pieces, whose prices
tell each piece what it costs to end in each state.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemill.llm.common import by_slices, kept

#: Columns of the lattice in one piece, and how far apart origins of the auction are.
PIECE, STRIDE = 2048, 16
#: Solved sequences of rows a task remembers, and their greatest length.
MEMO, MEMO_LENGTH = 20_000, 64
FAR = 1 << 60
# Costs of the edits, and of keeping a truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: nothing yet; after the system's row; after the user's; after the assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: What remains to be inserted where the rows end in a state, and its cost.
_TAIL = ("", "II", "I", "")
_TAIL_COST = tuple(len(t) * INSERT for t in _TAIL)
# Kinds of a row: the initial of its role as 1 to 3 (system, user, assistant) or 0, plus 4 if truncated; 8 is a row that must go.
_KIND = {"s": 1, "u": 2, "a": 3}
GONE = 8
# White space, and what ends a row that is not truncated.
_SPACES, _STOPS = " \t\n\v\f\r", ".!?"


@functools.cache
def _arcs(kind: int, count: int):
    """For each state: (letter, cost, how far the next node's number lies), by letter."""
    out = []
    for state in range(4):
        arcs = [("D", DELETE * count, 4)]
        arcs.append(("I", INSERT, _NEXT[state] - state))
        if kind != GONE:
            late, role = TRUNCATED * (kind >> 2), kind & 3
            after = _SYSTEM if role == 1 and state == _START else _NEXT[state] if role == _NEXT[state] else None
            if after is not None:
                arcs.append(("K", KEEP + late, 4 + after - state))
            arcs.append(("R", REROLE + late, 4 + _NEXT[state] - state))
        out.append(tuple(arcs))
    return tuple(out)


class Lattice:
    """Prices of one sequence of rows: ``(kind, count)``, where a count above 1 is of rows that must go.

    ``exits`` are the exact prices of the states after the last row.
    """

    def __init__(self, rows, exits):
        self.arcs = [arcs for kind, count in rows for arcs in _arcs(kind, count if kind == GONE else 1)]
        self.size = len(self.arcs)
        self.price = [0] * self.size + list(exits)
        self.exact = [False] * self.size + [True] * 4

    def close(self, states):
        """No way leads on from these states."""
        for state in states:
            for node in range(state, self.size, 4):
                self.price[node], self.exact[node] = FAR, True

    def auction(self, origin: int) -> int:
        """The distance from ``origin``; the nodes on its path become exact."""
        price, exact, arcs, path = self.price, self.exact, self.arcs, [origin]
        while True:
            node = path[-1]
            if exact[node]:
                break
            least, best = FAR, -1
            for _, cost, step in arcs[node]:
                asked = cost + price[node + step]
                if asked < least:
                    least, best = asked, node + step
            if price[node] < least:  # contraction
                price[node] = least
                if best < 0:
                    exact[node] = True
                if len(path) > 1:
                    path.pop()
            else:  # extension
                path.append(best)
        for node in path:
            exact[node] = True
        return price[origin]

    def converge(self) -> list[int]:
        """Distances from the states before the first row; origins are taken from the last rows on,
        so that each auction ends soon at nodes that are exact already. No way is shorter than
        what the next of them ask at least, so prices start there."""
        end = self.size
        for start in range((self.size // 4 - 1) // STRIDE * STRIDE * 4, -1, -4 * STRIDE):
            least = min(self.price[end : end + 4])
            for node in range(start, end):
                if not self.exact[node]:
                    self.price[node] = least
            for state in range(4):
                self.auction(start + state)
            end = start
        return [self.price[state] for state in range(4)]

    def trace(self, state: int) -> tuple[str, int]:
        """The least of the cheapest sequences of edits from ``state`` on, and the state it ends in."""
        letters, node = [], state
        while node < self.size:
            self.auction(node)
            for letter, cost, step in self.arcs[node]:
                after = node + step
                if self.price[node] == cost + self.price[after] and self.price[node] == cost + self.auction_at(after):
                    letters.append(letter)
                    node = after
                    break
        return "".join(letters), node - self.size

    def auction_at(self, node: int) -> int:
        return self.price[node] if self.exact[node] else self.auction(node)


def _expanded(letters: str, rows) -> str:
    """The letters with one for each row, where rows that must go were counted together."""
    if all(count == 1 for _, count in rows):
        return letters
    out, at = [], 0
    for letter in letters:
        if letter != "I":
            letter, at = letter * rows[at][1], at + 1
        out.append(letter)
    return "".join(out)


def solve(rows, entry: int = _START, exits=_TAIL_COST) -> tuple[int, str, int]:
    """Cost to the end, edits of these rows, and the state after them."""
    lattice = Lattice(rows, exits)
    cost = lattice.converge()[entry] if rows else exits[entry]
    letters, end = lattice.trace(entry)
    return cost, _expanded(letters, rows), end


def distances(rows) -> list[int]:
    """From each state before the rows to each state after them; by the first, then the second."""
    out = [[FAR] * 4 for _ in range(4)]
    for end in range(4):
        lattice = Lattice(rows, [0 if state == end else FAR for state in range(4)])
        if end in (_START, _SYSTEM):  # the pattern never leads back to them
            lattice.close((_USER, _ASSISTANT))
        for start, cost in enumerate(lattice.converge()):
            out[start][end] = cost
    return [cost for line in out for cost in line]


def boundary_prices(pieces: list[list[int]]) -> list[list[int]]:
    """For each piece the costs to the end from the states after it: an auction over the lattice of pieces."""
    lattice = Lattice([], _TAIL_COST)
    lattice.arcs = [
        tuple(("", cost, 4 + end - start) for end, cost in enumerate(piece[4 * start : 4 * start + 4]) if cost < FAR)
        for piece in pieces
        for start in range(4)
    ]
    lattice.size = len(lattice.arcs)
    lattice.price = [0] * lattice.size + list(_TAIL_COST)
    lattice.exact = [False] * lattice.size + [True] * 4
    for node in range(lattice.size - 1, -1, -1):
        lattice.auction(node)
    return [lattice.price[4 * i + 4 : 4 * i + 8] for i in range(len(pieces))]


def _lines(conversations, conv, turn, role, text):
    """Rows under fixed names, nulls of role and text as one space; ``digest`` tells texts apart."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text")
    )
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def _pieces(lines: DataFrame) -> DataFrame:
    """Conversations cut into pieces of rows in order: kinds and counts of the rows, and the first row's key.

    Equal rows are counted before they are sorted, and the sorted rows of one conversation may
    lie in any number of partitions. ``whole`` pieces are all of their conversation.
    """
    shown = F.rtrim("text", F.lit(_SPACES))
    role = F.lit(0)
    for initial, number in _KIND.items():
        role = F.when(F.startswith("role", F.lit(initial)), number).otherwise(role)
    kind = F.when(shown == "", GONE).otherwise(role + F.when(F.right(shown, F.lit(1)).isin(*_STOPS), 0).otherwise(4))
    counted = lines.select("conv", "turn", "role", "digest", kind.cast("int").alias("kind")).groupBy("conv", "turn", "role", "digest").agg(
        F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n")
    )
    counted, drop_counted = kept(counted, "turns")
    # Of rows with one role and text the first is no duplicate; nulls come first.
    first = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("conv", "role", "digest")]
    joined = counted.alias("l").join(first.alias("r"), same[0] & same[1] & same[2])
    joined = joined.select("l.*", (F.struct(F.col("l.turn").isNotNull(), "l.turn") > F.col("r.first")).alias("again"))
    joined, drop_joined = kept(joined, "faults")
    drop_counted()
    key = ["conv", "turn", "role", "digest"]
    ordered = joined.repartitionByRange(*[F.col(c).asc_nulls_first() for c in key]).sortWithinPartitions(*key)
    fields = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = StructType.fromDDL(
        ", ".join(f"{c} {fields[c]}" for c in key)
        + ", piece bigint, kinds array<tinyint>, counts array<bigint>, whole boolean, n_blank bigint, n_duplicate bigint, n_truncated bigint"
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        serial, out = TaskContext.get().partitionId() << 33, []
        current, first_of_all, parts = None, True, 0

        def close(whole):
            nonlocal serial
            head, kinds, counts, tallies = current
            out.append((*head, serial, kinds, counts, whole, *tallies))
            serial += 1

        def flush():
            rows = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(rows, arrow)], schema=arrow)

        for batch in by_slices(batches, 4096):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*key, "kind", "n", "again")]
            for conv, turn, role, digest, kind, n, again in zip(*columns):
                new = current is None or conv != current[0][0]
                if new or len(current[1]) >= PIECE:
                    if current is not None:
                        close(new and parts == 0 and not first_of_all)
                        first_of_all = first_of_all and not new
                        parts = 0 if new else parts + 1
                    current = ((conv, turn, role, digest), [], [], [0, 0, 0])
                _, kinds, counts, tallies = current
                blank = kind == GONE
                alive = not blank and not again
                if alive:
                    kinds.append(kind)
                    counts.append(1)
                    tallies[2] += kind >> 2
                gone = n - alive
                if gone:
                    tallies[0 if blank else 1] += gone
                    if kinds and kinds[-1] == GONE:
                        counts[-1] += gone
                    else:
                        kinds.append(GONE)
                        counts.append(gone)
            if len(out) >= 4096:
                yield flush()
        if current is not None:
            close(False)
            yield flush()

    pieces, _ = kept(ordered.mapInArrow(run, schema), "pieces")
    drop_joined()
    return pieces


def _mapped(df: DataFrame, columns: list[str], schema: str, function) -> DataFrame:
    """``function`` over rows of Python values; it returns a row."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in by_slices(batches):
            rows = list(zip(*[function(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(rows, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


_solved = functools.lru_cache(MEMO)(solve)


def _whole(piece, kinds, counts):
    rows = tuple(zip(kinds, counts))
    cost, letters, end = (_solved if len(rows) <= MEMO_LENGTH else solve)(rows)
    return piece, cost, letters + _TAIL[end], _START


def _edits(pieces: DataFrame) -> DataFrame:
    """``(piece, cost, letters, entry)``: the edits of each piece, the state before it, and what its
    conversation costs from there. Only conversations of several pieces need more than a map."""
    arrays, drops = ["piece", "kinds", "counts"], []

    def table(df, label):
        df, drop = kept(df, label)
        drops.append(drop)
        return df

    def by_conversation(df, what):
        return df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", what))).alias("found"))

    def crossed(conv, piece, kinds, counts):
        return conv, piece, distances(tuple(zip(kinds, counts)))

    def priced(found):
        return [f["piece"] for f in found], boundary_prices([f["reach"] for f in found])

    def traced(conv, piece, kinds, counts, exits):
        ways = [solve(tuple(zip(kinds, counts)), entry, exits) for entry in range(4)]
        return conv, piece, *zip(*ways)

    def chained(found):
        state, entries = _START, []
        for f in found:
            entries.append(state)
            state = f["ends"][state]
        return [f["piece"] for f in found], entries, [False] * (len(found) - 1) + [True]

    result = "piece bigint, cost bigint, letters string, entry int"
    alone = _mapped(pieces.where("whole"), arrays, result, _whole)
    parts = pieces.where(~F.col("whole"))
    conv = f"conv {parts.schema['conv'].dataType.simpleString()}, piece bigint"
    reach = table(_mapped(parts, ["conv", *arrays], f"{conv}, reach array<bigint>", crossed), "reach")
    prices = _mapped(by_conversation(reach, "reach"), ["found"], "piece array<bigint>, exits array<array<bigint>>", priced)
    prices = table(prices.select(F.inline(F.arrays_zip("piece", "exits"))), "prices")
    schema = f"{conv}, costs array<bigint>, ways array<string>, ends array<int>"
    ways = table(_mapped(parts.join(prices, "piece"), ["conv", *arrays, "exits"], schema, traced), "ways")
    chain = _mapped(by_conversation(ways, "ends"), ["found"], "piece array<bigint>, entry array<int>, final array<boolean>", chained)
    chain = chain.select(F.inline(F.arrays_zip("piece", "entry", "final")))
    at = F.col("entry")
    tail = F.when(F.col("final"), F.get(F.array(*map(F.lit, _TAIL)), F.get("ends", at))).otherwise("")
    several = ways.join(chain, "piece").select(
        "piece", F.get("costs", at).alias("cost"), F.concat(F.get("ways", at), tail).alias("letters"), "entry"
    )
    plan, _ = kept(alone.unionByName(several), "plan")
    for drop in drops:
        drop()
    return plan


def repaired_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The rows of all conversations with what to do to each: ``conv, turn, role, text, edit, new_role, new_text, cost``
    and, on the first row of each piece of a conversation, ``n_blank``, ``n_duplicate`` and ``n_truncated``.

    Roles shall follow ``(system? (user assistant)+)?``. ``edit`` is ``K`` (keep), ``R`` (another
    role), ``D`` (delete) or ``I`` (insert an empty row); deleted rows have no new role, inserted
    ones no old role. Blank rows and repetitions of an earlier role and text must be deleted. The
    edits are the cheapest, of equally cheap ones the least as letters; ``cost`` is that of all
    edits, on the first row of a conversation, else null. Rows of a conversation stand together, in
    order: by turn (nulls first), then role, then the MD5 of the text.

    Null roles and texts count as one space; null conversation ids are one conversation; rows equal
    in all are duplicates; an empty table gives no rows; other columns are not read. Texts are
    shuffled once. All that is solved runs over rows without texts: repeated rows are counted
    first, and a conversation of any length is cut into pieces that are solved in different tasks.
    """
    lines = _lines(conversations, conv_col, turn_col, role_col, text_col)
    pieces = _pieces(lines)
    plan = _edits(pieces)
    key = ["conv", "turn", "role", "digest"]
    numbers = ["n_blank", "n_duplicate", "n_truncated"]
    heads = pieces.join(plan, "piece").select(*key, F.lit(0).alias("is_row"), F.lit(None).cast("string").alias("text"), *numbers, "cost", "letters", "entry")
    stream = heads.unionByName(lines.select(*key, F.lit(1).alias("is_row"), "text"), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "is_row")
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = StructType.fromDDL(
        f"conv {kinds['conv']}, turn {kinds['turn']}, role string, text string, edit string, new_role string, new_text string,"
        " cost bigint, n_blank bigint, n_duplicate bigint, n_truncated bigint"
    )
    arrow = to_arrow_schema(schema)
    names = ["conv", "turn", "role", "is_row", "text", *numbers, "cost", "letters", "entry"]

    def run(batches):
        conv, letters, at, state, tallies, cost, started = None, "", 0, _START, (None,) * 3, None, False
        for batch in by_slices(batches):
            out = []

            def emit(turn, role, text, edit, new_role, new_text):
                nonlocal tallies, cost
                out.append((conv, turn, role, text, edit, new_role, new_text, cost, *tallies))
                tallies, cost = (None,) * 3, None

            def insert():
                nonlocal at, state
                while at < len(letters) and letters[at] == "I":
                    state, at = _NEXT[state], at + 1
                    emit(None, None, None, "I", "user" if state == _USER else "assistant", "")

            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for row in zip(*columns):
                if not row[3]:
                    new = not started or row[0] != conv
                    conv, started, tallies, letters, at = row[0], True, row[5:8], row[9], 0
                    state, cost = row[10], row[8] if new else None
                    insert()
                    continue
                edit, at = letters[at], at + 1
                new_role = None
                if edit != "D":
                    state = _SYSTEM if edit == "K" and row[2][:1] == "s" else _NEXT[state]
                    new_role = row[2] if edit == "K" else "user" if state == _USER else "assistant"
                emit(row[1], row[2], row[4], edit, new_role, row[4] if new_role is not None else None)
                insert()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), f.type) for x, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow
            )

    return stream.select(*names).mapInArrow(run, schema)


def damaged(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turn, role, text`` with faults that follow from the CRC-32 of conversation and turn.

    Of the remainders by 20, 0 drops a row, 1 empties its text, 2 removes its full stops and
    question and exclamation marks, 3 repeats it and 4 gives it to the user. Nulls count as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)), "UTF-8")) % 20
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("at"), shown(role_col).alias("said_by"), shown(text_col).alias("said"), fault.alias("fault")
    ).where("fault <> 0")
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.col("at").alias("turn"),
        F.when(F.col("fault") == 4, "user").otherwise(F.col("said_by")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("said", _STOPS, "")).otherwise(F.col("said")).alias("text"),
        F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"),
    ).select("conv_id", "turn", "role", "text", F.explode("times")).drop("col")


_LEGAL = {"su", "ua", "au"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """One row per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    ``gaps`` counts the turns that are missing between the least and the greatest, ``illegal`` the
    neighbouring rows whose roles do not follow one another, ``audit`` is the edits' letters and
    the digest that of the repaired rows ``role:text``, joined by line feeds. Rows come from
    ``repaired_conversations``, whose order this map relies on; a conversation's digest runs over
    its texts one by one, in memory for one of them.
    """
    repaired = repaired_conversations(conversations, conv_col, **columns)
    schema = StructType.fromDDL(
        f"{conv_col} {repaired.schema['conv'].dataType.simpleString()}, "
        + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, conv, started = [], None, False
        low = high = role = None
        turns, tallies, illegal, cost, letters, sha, rows = 0, [0, 0, 0], 0, 0, [], hashlib.sha256(), 0

        def close():
            gaps = high - low + 1 - turns if turns else 0
            out.append((conv, gaps, *tallies, illegal, cost, "".join(letters), sha.hexdigest()))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in by_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or row[0] != conv:
                    if started:
                        close()
                    conv, started, low, high, role = row[0], True, None, None, None
                    turns, tallies, illegal, cost, letters, sha, rows = 0, [0, 0, 0], 0, row[6], [], hashlib.sha256(), 0
                _, turn, old_role, edit, new_role, new_text = row[:6]
                letters.append(edit)
                if edit != "I":
                    if turn is not None and turn != high:
                        low, high, turns = turn if low is None else low, turn, turns + 1
                    if role is not None and role + old_role[:1] not in _LEGAL:
                        illegal += 1
                    role = old_role[:1]
                for i, n in enumerate(row[7:]):
                    tallies[i] += n or 0
                if new_role is not None:
                    sha.update(f"{chr(10) if rows else ''}{new_role}:{new_text}".encode())
                    rows += 1
            if len(out) >= 1024:
                yield flush()
        if started:
            close()
            yield flush()

    return repaired.drop("text").mapInArrow(run, schema)


def damage_and_repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``repair_report`` of the damaged rows, for every conversation there was before.

    One of which no row is left has zeros, no edits and the digest of the empty string.
    """
    report = repair_report(damaged(conversations, conv_col, turn_col, role_col, text_col))
    report = report.withColumnRenamed("conv_id", "found")
    every = conversations.select(F.col(conv_col).alias("conv_id")).distinct()
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(report, F.col("conv_id").eqNullSafe(F.col("found")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )
