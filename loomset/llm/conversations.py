"""Repair of the structure of conversations at least cost, as a fold in Spark SQL.

Of each conversation's rows, by turn (nulls first; then role, text), the first fault counts: blank (no character but white space), duplicate
(role and text seen earlier) or truncated (the last such character ends no sentence). Four windows over one shuffle by conversation give
the faults, each row's place, and steps of turn and role. Then edits are chosen: Keep costs 0, Rerole to user or assistant
1, Delete 2 (blank and duplicate rows must go), Insert an empty turn of user or assistant 5, and a truncated row that stays adds 5. The roles
that remain, by their initials, are nothing, or an optional s and then pairs ua. Of the cheapest edits the ASCII-least string of initials is
taken.

Sorted structs of a conversation are folded by aggregate(): its state has a (cost, audit) struct for each of the four places in that
pattern, and each step takes the least of those that lead to a place. Equal costs are settled by the audits. Two audits of one place and
row never are one the other's beginning unless one has more inserts, and thus costs more, so the least stays the least whatever
follows.

Audits grow with the conversation, so a fold over many turns would copy them often. Rows are therefore folded in blocks of BLOCK turns, from
each of the four places, and the blocks' results are joined by a second fold: the same edits, at a small part of the work. Blocks of one
conversation stay in the partition that the first shuffle put them in.

A conversation is one row of the result, whose audit has a letter a turn and whose turns hold its texts, so it must fit into one row; texts of
blank and duplicate rows, which must go, are not collected. Null role or text is one space. Rows with a null conversation are one
conversation. Rows that repeat one another are duplicates. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.common import unused

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
BLOCK = 256
#: The cost of a place that can't be reached.
FAR = 1 << 40
SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
PLACES = ("start", "system", "user", "assistant")


def damage(conversations: DataFrame, dropped: str = "dropped") -> DataFrame:
    """conv_id, turn, role and text with faults that crc32 of `conv_id:turn` chooses. Rows that go stay with `dropped` true.

    Of twenty values 0 drops the row, 1 empties its text, 2 takes sentence ends out of it, 3 repeats it, 4 makes it the user's. Nulls are one
    space, in the key too.
    """
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text")).alias("text"),
        (kind == 0).alias(dropped),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"),
    )
    return rows.withColumn("times", F.explode("times")).drop("times")


def _grown(place: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((place["cost"] + cost).alias("cost"), F.concat(place["audit"], F.lit(letter)).alias("audit"))


def _inserted(state: Column) -> tuple[Column, Column]:
    """(user, assistant) with the inserts that may come before the next row or the end."""
    user = F.least(state["user"], *(_grown(state[x], INSERT, "I") for x in ("start", "system", "assistant")))
    return user, F.least(state["assistant"], _grown(user, INSERT, "I"))


def _places(*each: Column) -> Column:
    return F.struct(*(x.alias(name) for x, name in zip(each, PLACES, strict=True)))


def _from(place: str | None) -> Column:
    """The state of a fold that begins at one place."""
    return _places(*(F.struct(F.lit(0 if x == place else FAR).cast("long").alias("cost"), F.lit("").alias("audit")) for x in PLACES))


def _step(state: Column, row: Column) -> Column:
    """The state after one row."""
    user, assistant = _inserted(state)
    before = {"start": state["start"], "system": state["system"], "user": user, "assistant": assistant}
    gone = {x: _grown(before[x], DELETE, "D") for x in PLACES}
    stays = F.when(row["fault"] == "truncated", F.lit(CUT)).otherwise(F.lit(0)).cast("long")

    def turned(initial: str, came: Column) -> Column:
        same = row["initial"] == initial
        return F.struct((came["cost"] + stays + F.when(same, F.lit(KEEP)).otherwise(F.lit(REROLE))).alias("cost"), F.concat(came["audit"], F.when(same, "K").otherwise("R")).alias("audit"))

    must = row["fault"].isin("blank", "duplicate")
    stayed = _places(
        gone["start"],
        F.when(row["initial"] == "s", F.least(gone["system"], _grown(state["start"], stays + KEEP, "K"))).otherwise(gone["system"]),
        F.least(gone["user"], turned("u", F.least(state["start"], state["system"], assistant))),
        F.least(gone["assistant"], turned("a", user)),
    )
    return F.when(must, _places(*gone.values())).otherwise(stayed)


def _joined(state: Column, block: Column) -> Column:
    """The state after a block, whose results there are for each place to begin at."""

    def led(to: str) -> Column:
        ways = [F.struct((state[x]["cost"] + block["done"][k][to]["cost"]).alias("cost"), F.concat(state[x]["audit"], block["done"][k][to]["audit"]).alias("audit")) for k, x in enumerate(PLACES)]
        return F.least(*ways)

    return _places(*(led(x) for x in PLACES))


def _marked(turns: DataFrame, dropped: Column) -> DataFrame:
    """Rows with fault, place, and whether turn and role go on as they should; nothing of a dropped row counts."""
    null_is_space: Callable[[str], Column] = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), null_is_space("role").alias("role"), null_is_space("text").alias("text"), dropped.alias("dropped")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    whole = Window.partitionBy("conv_id", "dropped").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "nth")
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("initial", F.substring("role", 1, 1))
    rows = rows.withColumns({"place": F.row_number().over(whole) - 1, "before": F.lag("initial").over(whole), "turn_before": F.lag("turn").over(whole)})
    fault = F.when(~F.col("text").rlike(SOLID), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(ENDED), "truncated").otherwise("")
    rows = rows.withColumn("fault", fault)
    return rows.select(
        "conv_id", "dropped", "turn", "place", "fault", "initial",
        F.expr(f"place div {BLOCK}").alias("block"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        F.when(~F.col("fault").isin("blank", "duplicate"), F.col("role")).alias("role"),
        F.when(~F.col("fault").isin("blank", "duplicate"), F.col("text")).alias("text"),
    )


def repair(turns: DataFrame, dropped: Column | None = None) -> DataFrame:
    """For each conv_id: gaps, blank, duplicate, truncated and illegal (counts), cost and audit of the edits, and the repaired turns as (role, text).

    gaps counts the turns missing between the least and the greatest; illegal counts neighbours whose role initials are not su, ua or au.
    dropped: rows that say only that there is such a conversation.
    """
    marked = _marked(turns, F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False)))
    here = ~F.col("dropped")
    count = lambda what: F.count(F.when(here & what, 1))
    counts = {"new_turns": F.col("new_turn"), "illegal": F.col("illegal")} | {x: F.col("fault") == x for x in ("blank", "duplicate", "truncated")}
    row = F.struct("place", "fault", "initial", "role", "text")
    blocks = marked.groupBy("conv_id", F.when(here, F.col("block")).alias("block")).agg(
        F.min(F.when(here, F.col("turn"))).alias("first_turn"), F.max(F.when(here, F.col("turn"))).alias("last_turn"), *(count(x).alias(name) for name, x in counts.items()), F.array_sort(F.collect_list(F.when(here, row))).alias("turns")
    )
    folds = [F.aggregate("turns", _from(x), _step) for x in PLACES]
    blocks = blocks.withColumn("done", F.when(F.col("block") == 0, F.array(folds[0])).when(F.col("block") > 0, F.array(*folds)))
    found = blocks.groupBy("conv_id").agg(
        (F.max("last_turn") - F.min("first_turn") + 1 - F.sum("new_turns")).alias("gaps"), *(F.sum(x).alias(x) for x in counts if x != "new_turns"), F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "turns", "done")))).alias("blocks")
    )
    begun = F.coalesce(F.get(F.col("blocks"), F.lit(0))["done"][0], _from("start"))
    found = found.withColumn("end", F.aggregate(F.slice("blocks", 2, F.greatest(F.size("blocks") - 1, F.lit(0))), begun, _joined))
    best = F.least(F.col("end")["start"], _inserted(F.col("end"))[1])
    found = found.withColumn("best", best).withColumn("rows", F.flatten(F.transform("blocks", lambda b: b["turns"])))
    found = found.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *(x for x in counts if x != "new_turns"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), _edited(F.col("best.audit"), F.col("rows")).alias("emitted"))
    system = F.when(F.get(F.col("emitted"), F.lit(0))["initial"] == "s", F.lit(1)).otherwise(F.lit(0))
    turned = lambda x, k: F.struct(F.when(x["letter"] == "K", x["role"]).when((k - system) % 2 == 0, "user").otherwise("assistant").alias("role"), x["text"].alias("text"))
    return found.withColumn("turns", F.transform("emitted", turned)).drop("emitted")


def _edited(audit: Column, rows: Column) -> Column:
    """The rows that stay and those inserted, in order, with the letter of the edit. initial: of a row kept as it is."""

    def struct(letter: Column, initial: Column, role: Column, text: Column) -> Column:
        return F.struct(letter.alias("letter"), initial.alias("initial"), role.alias("role"), text.alias("text"))

    empty = struct(F.lit("I"), F.lit(""), F.lit(""), F.lit(""))

    def one(letters: Column, row: Column) -> Column:
        letter = F.right(letters, F.lit(1))
        return F.concat(F.array_repeat(empty, F.length(letters) - 1), F.array(struct(letter, F.when(letter == "K", row["initial"]).otherwise(""), row["role"], row["text"])))

    last = F.array_repeat(empty, F.length(audit) - F.length(F.rtrim(audit, F.lit("I"))))
    letters = F.regexp_extract_all(audit, F.lit("I*[DKR]"), F.lit(0))
    return F.filter(F.concat(F.flatten(F.zip_with(letters, rows, one)), last), lambda x: x["letter"] != "D")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """repair() of damage(), with the sha256 of the repaired turns, a line each, instead of the turns."""
    dropped = unused(conversations, "dropped")
    found = repair(damage(conversations, dropped), F.col(dropped))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return found.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("turns")
