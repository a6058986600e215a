"""Conversation threads, trajectories, usage and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Turns of one thread that a task sees together.
SPAN = 10_000


def with_context(turns: DataFrame, thread: str, turn: str, values: list[str], span: int = SPAN) -> DataFrame:
    """turns with previous_<value> of the turn before in the same thread, and turns_so_far.

    turn: a number. A thread is cut into spans of turns, each worked on by
    itself; what a span hands to the next is one row, so that a thread of any
    length is spread. The first turn of a thread has null context. Rows with a
    null thread are one thread, rows with a null turn its first; of equal turns
    either may come first.
    """
    cut = turns.withColumn("_span", F.floor(F.coalesce(F.col(turn), F.lit(0)) / span))
    by = Window.partitionBy(thread, "_span").orderBy(turn)
    own = {f"_previous_{i}": F.lag(v).over(by) for i, v in enumerate(values)} | {"_so_far": F.row_number().over(by)}
    ends = cut.groupBy(thread, "_span").agg(F.max(F.struct(turn, *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])).alias("_last"), F.count("*").alias("_n"))
    before = Window.partitionBy(thread).orderBy("_span")
    ends = ends.select(F.col(thread).alias("_thread"), F.col("_span").alias("_own"), F.lag("_last").over(before).alias("_last"), F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = cut.withColumns(own).join(ends, F.col(thread).eqNullSafe(F.col("_thread")) & (F.col("_span") == F.col("_own")))
    context = {f"previous_{v}": F.when(F.col("_so_far") > 1, F.col(f"_previous_{i}")).otherwise(F.col("_last")[f"_v{i}"]) for i, v in enumerate(values)}
    new = context | {"turns_so_far": (F.col("_so_far") + F.col("_before")).cast("int")}
    return joined.select(*[c for c in turns.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def trajectory(steps: DataFrame, thread: str, step: str, node: str, limit: int) -> DataFrame:
    """thread, n_steps, path, most_visits, within_limit: the nodes of a request in order, and whether none was visited more than `limit` times.

    The path of a request is held whole: a request has few steps by nature, and
    one row carries its path in the end.
    """
    path = steps.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct(step, node))).alias("_p"))
    visits = steps.groupBy(thread, node).agg(F.count("*").alias("n")).groupBy(thread).agg(F.max("n").alias("most_visits"))
    joined = path.join(visits, thread)
    return joined.select(thread, F.size("_p").alias("n_steps"), F.array_join(F.transform("_p", lambda x: x[node]), ">").alias("path"), "most_visits", (F.col("most_visits") <= limit).alias("within_limit"))


def ordered_rule(names: list[str], then: list[str], never: list[str]) -> list[list[int]]:
    """The automaton of "these in this order, and none of those ever", as state x symbol → state.

    Symbols are the places in names, and one more for anything else. State n: so
    many of `then` were met; the last state is the dead one, entered with a name of
    `never` and never left. A name of both lists is forbidden.
    """
    dead = len(then) + 1

    def step(state: int, name: str | None) -> int:
        if state == dead or name in never:
            return dead
        return state + 1 if state < len(then) and name == then[state] else state

    return [[step(state, name) for name in [*names, None]] for state in range(dead + 1)]


def run_automaton(steps: DataFrame, thread: str, step: str, symbol: Column, table: list[list[int]], span: int = SPAN) -> DataFrame:
    """thread, n_steps, state, dead_at: the state that a thread's steps lead to from state 0, and the first step that leads to the last state (the dead one).

    symbol: the column of the table for each row. step: a number; equal ones stand
    in the order of their symbols, and rows with a null step or symbol take no
    part. A null thread is a thread. A span of steps is folded by itself, from
    every state at once, into what it makes of each; a thread then folds its spans,
    one row each. So a thread of any length is spread over tasks.
    """
    states, width = len(table), len(table[0])
    dead, flat = states - 1, F.array(*[F.lit(to) for row in table for to in row])
    rows = steps.select(F.col(thread), F.col(step).alias("_step"), symbol.cast("int").alias("_symbol")).where("_step IS NOT NULL AND _symbol IS NOT NULL")
    kind = f"struct<state:int,at:{rows.schema['_step'].dataType.simpleString()}>"
    start = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(None).alias("at")).cast(kind) for s in range(states)])

    def move(held: Column, x: Column) -> Column:
        def one(s: Column) -> Column:
            to = F.get(flat, s["state"] * width + x["_symbol"])
            return F.struct(to.alias("state"), F.when((to == dead) & (s["state"] != dead), x["_step"]).otherwise(s["at"]).alias("at"))

        return F.transform(held, one)

    spans = rows.groupBy(thread, F.floor(F.col("_step") / span).alias("_span")).agg(F.array_sort(F.collect_list(F.struct("_step", "_symbol"))).alias("_own"))
    spans = spans.select(thread, "_span", F.size("_own").alias("_n"), F.aggregate("_own", start, move).alias("_makes"))
    whole = spans.groupBy(thread).agg(F.sum("_n").alias("n_steps"), F.array_sort(F.collect_list(F.struct("_span", "_makes"))).alias("_spans"))

    def follow(s: Column, x: Column) -> Column:
        to = F.get(x["_makes"], s["state"])
        return F.struct(to["state"].alias("state"), F.coalesce(s["at"], to["at"]).alias("at"))

    end = F.aggregate("_spans", F.get(start, 0), follow)
    return whole.select(thread, "n_steps", end["state"].alias("state"), end["at"].alias("dead_at"))


def obeys(steps: DataFrame, thread: str, step: str, names: list[tuple[str, Column]], then: list[str], never: list[str], span: int = SPAN) -> DataFrame:
    """thread, n_steps, met, broken_at, obeyed: whether a request's steps hold `then` in this order and nothing of `never`.

    names: what a step may be called and when, of which the first that holds
    counts, so that a rule can speak of nodes and of tools. met: how many of
    `then` were met before the rule was kept or broken (null once broken);
    broken_at: the step that broke it.
    """
    unknown = set(then) | set(never)
    if unknown := unknown - {n for n, _ in names}:
        raise ValueError(f"no such step: {sorted(unknown)}")
    symbol = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), i) for i, (_, test) in enumerate(names)], F.lit(len(names)))
    table = ordered_rule([n for n, _ in names], then, never)
    done = run_automaton(steps, thread, step, symbol, table, span)
    broken = F.col("state") == len(table) - 1
    return done.select(thread, "n_steps", F.when(~broken, F.col("state")).alias("met"), F.col("dead_at").alias("broken_at"), (F.col("state") == len(then)).alias("obeyed"))


def usage(requests: DataFrame, by: str, cost: Column, question: Column) -> DataFrame:
    """by, requests, total_cost, cost_per_100: total cost per 100 distinct questions (four places).

    Null costs add nothing and null questions are not counted; without a question
    cost_per_100 is null. A null `by` is a group. Repeated rows are requests each.
    """
    return requests.groupBy(by).agg(F.count("*").alias("requests"), F.round(F.sum(cost), 4).alias("total_cost"), F.round(100.0 * F.sum(cost) / F.countDistinct(question), 4).alias("cost_per_100"))


def tumbling(requests: DataFrame, ts: str, width: str, user: str) -> DataFrame:
    """window_start, user, n: requests per user and window. ts is a timestamp with time zone UTC; rows without one go. A null user is a user; repeated rows count each."""
    counted = requests.groupBy(F.window(F.col(ts).cast("timestamp"), width), F.col(user)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), user, "n")


def rolling(requests: DataFrame, ts: str, seconds: int, user: str, limit: int) -> DataFrame:
    """requests with n_recent (requests of the user in so many seconds up to and with this one) and limited. Equal times count each other; rows without a time count themselves alone as one time; a null user is a user.

    Requests are counted by second first. Time is cut into spans as long as the
    limit looks back, so a second needs its own span and the one before: each count
    goes to its span and, as context, to the next, and the sum is taken within
    them. No task holds more than two spans of a user, however many requests that
    user makes.
    """
    own = requests.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp")))
    counts = own.groupBy(F.col(user).alias("_user"), F.col("_s").alias("_at")).agg(F.count("*").alias("_n"))
    span = F.floor(F.col("_at") / (seconds + 1))
    both = counts.withColumn("_span", F.explode(F.when(F.col("_at").isNull(), F.array(span)).otherwise(F.array(span, span + 1))))
    by = Window.partitionBy("_user", "_span").orderBy("_at").rangeBetween(-seconds, 0)
    summed = both.withColumn("n_recent", F.sum("_n").over(by)).where(F.col("_at").isNull() | (F.col("_span") == span)).select("_user", "_at", "n_recent")
    joined = own.join(summed, F.col(user).eqNullSafe(F.col("_user")) & F.col("_s").eqNullSafe(F.col("_at")))
    return joined.select(*[c for c in requests.columns if c not in ("n_recent", "limited")], "n_recent", (F.col("n_recent") > limit).alias("limited"))
