"""Running schedules: all worlds of a batch advance together, each on the wire where it stands.

The worlds' tables are never split. A control table says for each world where it is, its turn, and whether it is done;
a box works on the worlds of its input wires and moves them to its outputs. Where worlds lie is told by labels, a new
one for each move, and the driver keeps which labels a wire has and how many worlds each: wires that meet, are renamed
or lead back, and worlds that are done and wait, cost no job. After each box that changes something, what it changed is
checkpointed in the shared folder, so plans stay short and lost executors cost little.

A loop that only deletes one matched row after another, by the first match each time, is run as one pass: its firings
are the legal matches in their order, and its events, decisions, snapshots and changes follow from the ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.agents import Agent, Context, First
from tessera.experience import After, Span
from tessera.functions.numbering import ranked
from tessera.operators import matching, rewriting
from tessera.operators.incremental import MatchCache
from tessera.operators.matching import tick
from tessera.plans.schedule import AgentLoop, Coin, Merge, MoreThan, PlayerRuleApp, Query, RuleApp, Schedule, Split, Weaken, While, boxes_of, lone
from tessera.world import World, shared, written

#: One row for each decision of a player.
EXPERIENCE = (
    "world_id bigint, step bigint, player string, turn bigint, box string, rule string, action string, match map<string,bigint>, legal bigint, legal_actions array<map<string,bigint>>, "
    "done boolean, winner string, info map<string,string>, schedule_path array<string>"
)
EVENT = "world_id bigint, step bigint, box string, rule string, fired boolean"


@dataclass
class Options:
    agents: Mapping[str, Agent]
    t_max: int | None = None
    terminal: Callable[[World], DataFrame] | None = None
    seed: int = 0
    most_passes: int | None = None
    keep_legal: bool = False
    snapshots: bool = False
    log_changes: bool = False


@dataclass
class Result:
    """world: the batch at the end. control: world_id, turn, done, winner, exit_wire. experiences, events: tables.

    snapshots: the tables after each step of a player, by step. changes: rows added, changed and deleted, where they were logged.
    """

    world: World
    control: DataFrame
    experiences: DataFrame
    events: DataFrame
    snapshots: list[tuple[int, Mapping[str, DataFrame]]] = field(default_factory=list)
    changes: DataFrame | None = None


#: Unions of the control table with rows of a box before it is written down again.
MOST_UNIONS = 8
#: Tables of events, decisions or changes before they are written down as one.
MOST_LOGS = 64


def checkpointed(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without their lineage; their jobs run side by side."""
    if len(tables) < 2:
        return {k: written(t) for k, t in tables.items()}
    with ThreadPoolExecutor(len(tables)) as pool:
        waits = {k: pool.submit(written, t) for k, t in tables.items()}
        return {k: w.result() for k, w in waits.items()}


def drawn(seed: int, step: int, name: str) -> Column:
    """A draw in [0, 1) for each world: 52 bits of a digest that any engine can take."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), F.col("world_id").cast("string"), F.lit(name))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


class Runner:
    def __init__(self, world: World, options: Options):
        self.spark = world.spark
        shared(self.spark)
        self.world, self.options = world, options
        self.step = 0
        self.experiences: list[DataFrame] = []
        self.events: list[DataFrame] = []
        self.changes: list[DataFrame] = []
        self.snapshots: list[tuple[int, Mapping[str, DataFrame]]] = []
        self.caches: dict[str, MatchCache] = {}
        #: worlds by (label, done)
        self.held: dict[tuple[str, bool], int] = {}
        #: labels of each wire; those with a flag only as far as worlds are done, or aren't
        self.lies: dict[str, set[tuple[str, bool | None]]] = {}
        self.moves = self.unions = 0
        self.state = world.ids.select("world_id", F.lit("").alias("wire"), F.lit(0).cast("long").alias("turn"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("winner"))

    # -- wires

    def label(self, wire: str) -> str:
        """A new label for worlds that come to a wire: a number, a bar, the wire."""
        self.moves += 1
        return f"{self.moves}|{wire}"

    def place(self, wires: tuple[str, ...]) -> Column:
        """Whether a row of the control table is on one of the wires."""
        found = F.lit(False)
        for flag in (None, False, True):
            labels = sorted(x for w in wires for x, f in self.lies.get(w, ()) if f is flag)
            if labels:
                here = F.col("wire").isin(labels)
                found = found | (here if flag is None else here & (F.col("done") == flag))
        return found

    def on(self, wires: tuple[str, ...]) -> DataFrame:
        return self.state.where(self.place(wires))

    def many_on(self, wires: tuple[str, ...]) -> int:
        return sum(self.held.get((x, d), 0) for w in wires for x, f in self.lies.get(w, ()) for d in (False, True) if f is None or f is d)

    def any_on(self, wires: tuple[str, ...]) -> bool:
        return self.many_on(wires) > 0

    def settle(self, state: DataFrame) -> None:
        """The new state, and how many worlds have each label; new labels lie on the wires that they name."""
        self.state = written(state)
        self.prune()
        known = {x for entries in self.lies.values() for x, _ in entries}
        self.held = {(r["wire"], r["done"]): r["count"] for r in self.state.groupBy("wire", "done").count().collect()}
        for x in {x for x, _ in self.held} - known:
            self.lies.setdefault(x.partition("|")[2], set()).add((x, None))

    def prune(self) -> None:
        """Forget labels that no world had when they were last counted: none gets an old label."""
        there = {x for x, _ in self.held}
        self.lies = {w: kept for w, entries in self.lies.items() if (kept := {(x, f) for x, f in entries if x in there})}

    def log(self, logs: list[DataFrame], rows: DataFrame) -> None:
        """Add rows; many small tables become one, so that neither plans nor what the driver holds grow with steps."""
        logs.append(rows)
        if len(logs) >= MOST_LOGS:
            logs[:] = [written(reduce(DataFrame.unionByName, logs).coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))]

    def move(self, wires: tuple[str, ...], to: DataFrame) -> None:
        """Worlds on `wires` go where to(world_id, out, and any of turn, done, winner) says."""
        mark = self.label("")
        given = to.select(F.col("world_id").alias("_w"), *[F.col(c).alias(f"_{c}") for c in to.columns if c != "world_id"])
        s = self.state.join(given, F.col("world_id") == F.col("_w"), "left")
        here = F.col("_w").isNotNull() & self.place(wires)
        cols = [F.col("world_id"), F.when(here, F.concat(F.lit(mark), F.col("_out"))).otherwise(F.col("wire")).alias("wire")]
        cols += [(F.when(here, F.col(f"_{c}")).otherwise(F.col(c)) if c in to.columns else F.col(c)).alias(c) for c in ("turn", "done", "winner")]
        self.settle(s.select(*cols))

    def rename(self, to: Mapping[str, str]) -> None:
        """All worlds on a wire go to another, without a look at them."""
        taken = {a: self.lies.pop(a, set()) for a in to}
        for a, b in to.items():
            self.lies.setdefault(b, set()).update(taken[a])

    def park(self, wires: tuple[str, ...]) -> None:
        """Worlds that are done go from each wire to one beside it."""
        for w in wires:
            entries = self.lies.pop(w, set())
            self.lies[w] = {(x, False) for x, f in entries if f is not True}
            self.lies.setdefault(f"{w}!done", set()).update((x, True) for x, f in entries if f is not False)

    def worlds(self, here: DataFrame, wires: tuple[str, ...]) -> World:
        """The worlds of here, or all where those on `wires` are a good part of them: filtering every table costs more
        plan than it saves work, and results are joined with `here` anyway."""
        if 4 * self.many_on(wires) >= sum(self.held.values()):
            return self.world
        return self.world.only(here)

    # -- boxes

    def run_box(self, box: Any, inputs: tuple[str, ...], outputs: tuple[str, ...], path: tuple[str, ...], pins: tuple[DataFrame, tuple[str, ...]] | None) -> None:
        if not self.any_on(inputs):
            return
        here = self.on(inputs).select("world_id")
        outs = [*outputs, *[f"{'/'.join(path)}:dropped"] * box.outputs]
        if isinstance(box, (Merge, Weaken)):
            self.rename({w: outs[0] for w in inputs})
        elif isinstance(box, (Coin, Split)):
            self.step += 1
            weights = (box.p, 1 - box.p) if isinstance(box, Coin) else box.weights
            u = drawn(self.options.seed, self.step, box.name) * float(sum(weights))
            out, below = F.lit(outs[len(weights) - 1]), 0.0
            sums = []
            for w in weights[:-1]:
                below += w
                sums.append(below)
            for i in range(len(sums) - 1, -1, -1):
                out = F.when(u < sums[i], F.lit(outs[i])).otherwise(out)
            self.move(inputs, here.withColumn("out", out))
        elif isinstance(box, Query):
            found = matching.match(box.pattern, self.worlds(here, inputs), box.monic).select("world_id").distinct().withColumn("_yes", F.lit(True))
            self.move(inputs, here.join(found, "world_id", "left").select("world_id", F.when(F.col("_yes"), F.lit(outs[0])).otherwise(F.lit(outs[1])).alias("out")))
        elif isinstance(box, (RuleApp, PlayerRuleApp)):
            self.run_rule(box, inputs, outs, here, pins, path)
        elif isinstance(box, AgentLoop):
            self.run_agents(box, inputs, outs, here, path)
        elif isinstance(box, While):
            top = f"{'/'.join(path)}:{box.name}"
            self.rename({w: f"{top}>" for w in inputs})
            if pins is None and self.sweep_while(box, (f"{top}>",), outs[0]):
                return
            # where nothing is drawn or chosen, a pass without a firing would come again for ever
            native = not boxes_of(box.body, (PlayerRuleApp, Coin, Split))
            for _ in range(box.most) if box.most is not None else count():
                before = self.world
                now = self.on((f"{top}>",)).where(~F.col("done")).select("world_id")
                going = box.test(self.world.only(now)).select("world_id").withColumn("_go", F.lit(True))
                self.move((f"{top}>",), self.on((f"{top}>",)).select("world_id").join(going, "world_id", "left").select("world_id", F.when(F.col("_go"), F.lit(f"{top}!")).otherwise(F.lit(outs[0])).alias("out")))
                if not self.any_on((f"{top}!",)):
                    break
                self.run_body(box.body, (f"{top}!",), (f"{top}>",), (*path, box.name), pins)
                if native and self.world is before:
                    break
            self.rename({f"{top}>": outs[0]})
        elif isinstance(box, Schedule):
            self.run_nested(box, inputs, outs, path, pins)
        else:
            raise TypeError(f"no box: {box!r}")

    def run_body(self, body: Any, inputs: tuple[str, ...], outs: tuple[str, ...], path: tuple[str, ...], pins) -> None:
        """A body whose outputs all meet on one wire."""
        ends = tuple(f"{'/'.join(path)}:{body.name}#{i}" for i in range(body.outputs))
        self.run_box(body, inputs, ends, path, pins)
        self.rename({e: outs[0] for e in ends})

    def candidates(self, box: RuleApp | PlayerRuleApp, world: World, here: DataFrame, pins) -> tuple[DataFrame, tuple[str, ...]]:
        """The legal matches in the worlds of `here`, and the columns of which each value gets one choice."""
        rule = box.rule
        groups: tuple[str, ...] = ("world_id",)
        pinned = None
        if pins is not None:
            rows, agents = pins
            if box.in_hom:
                held = {to: a for a, to in reversed(box.in_hom.items())}
                rows = rows.join(here, "world_id", "left_semi")
                for a, to in box.in_hom.items():
                    rows = rows if held[to] == a else rows.where(tick(a) == tick(held[to]))
                pinned = rows.select("world_id", *[tick(a).alias(to) for to, a in held.items()], *[tick(a).alias(f"@{a}") for a in agents])
                groups = ("world_id", *[f"@{a}" for a in agents])
        player = isinstance(box, PlayerRuleApp)
        if player and box.fast_match_fn is not None:
            found = rule.guard.applied(box.fast_match_fn(rule, world), rule.left, world)
        elif player and box.use_cache and box.view_fn is None:
            cache = self.caches.setdefault(box.name, None) or MatchCache.fresh(rule, self.world)
            self.caches[box.name] = cache
            found = cache.legal(self.world).join(here, "world_id", "left_semi")
        else:
            # the search starts from the agents' rows
            own = None if pinned is None else pinned.select("world_id", *[tick(e) for e in held])
            found = rewriting.legal(rule, world, pins=own, view=box.view_fn if player else None)
        found = found.join(here, "world_id", "left_semi")
        if pinned is not None:
            keys = ["world_id", *dict.fromkeys(box.in_hom.values())]
            found = found.join(pinned, keys)
        if player and box.take is not None:
            n = box.take(self.step, box.name) if callable(box.take) else box.take
            w = [F.xxhash64(F.lit(self.options.seed), F.lit(self.step), F.col("world_id"), *[tick(e) for e in rule.left.elements])]
            found = self._first(found, groups, n, w + matching.order(rule.left))
        if player and box.match_limit is not None:
            found = self._first(found, groups, box.match_limit, matching.order(rule.left))
        return found, groups

    @staticmethod
    def _first(df: DataFrame, groups, n: int, by) -> DataFrame:
        from pyspark.sql.window import Window

        w = Window.partitionBy(*[tick(g) for g in groups]).orderBy(*by)
        return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")

    def run_rule(self, box, inputs, outs, here, pins, path, at_once: bool = False) -> None:
        self.step += 1
        rule, player = box.rule, isinstance(box, PlayerRuleApp)
        world = self.worlds(here, inputs)
        found, groups = self.candidates(box, world, here, pins)
        found = found.withColumn("passes", F.lit(False))
        elements = tuple(rule.left.elements)
        offered = found
        if player and box.can_pass:
            # passing is offered where there is something to pass
            none = found.select(*[tick(g) for g in groups]).distinct()
            offered = found.unionByName(none.withColumn("passes", F.lit(True)), allowMissingColumns=True)
        turns = self.on(inputs).select("world_id", "turn")
        agent = self.options.agents.get(box.player) if player else First()
        if agent is None:
            raise KeyError(f"no agent for player {box.player}")
        ctx = Context(world, box.player if player else "", self.step, elements, self.options.seed, groups, turns)
        picked = agent.choose(offered, ctx)
        if player:
            # what was offered is counted in the same job
            picked = self._offered(rule, offered).join(picked, F.col("#world") == F.col("world_id"), "left")
        picked = written(picked)
        chosen = picked.where("world_id is not null and not passes").drop("passes", "#world", "#legal", "#actions")
        if at_once:
            rank = [tick(g) for g in groups[1:]] + [tick(e) for e in elements]
            chosen = rewriting.independent(rule, chosen, rank).checkpoint()
        fired = chosen.select("world_id").distinct()
        any_fired = not chosen.isEmpty()  # of a checkpoint
        before = self.world
        if any_fired:
            self.rewrite(rule, chosen.select("world_id", *[tick(c) for c in chosen.columns if c not in ("world_id", *groups)]))
            if self.options.log_changes:
                from tessera.operators.changes import between

                self.log(self.changes, between(before, self.world).withColumn("step", F.lit(self.step).cast("long")).withColumn("box", F.lit(box.name)))
        s = self.on(inputs).select("world_id", "turn", "done", "winner").join(fired.withColumn("_fired", F.lit(True)), "world_id", "left").withColumn("_fired", F.coalesce("_fired", F.lit(False)))
        if player:
            s = s.withColumn("turn", F.col("turn") + 1)
            if self.options.terminal is not None and any_fired:
                # worlds in which nothing fired may be asked as well, but keep their state
                end = self.options.terminal(self.worlds(fired, inputs)).select("world_id", F.col("done").alias("_end"), F.col("winner").cast("string").alias("_winner"))
                s = s.join(end, "world_id", "left").withColumn("_end", F.coalesce("_end", F.lit(False)) & F.col("_fired"))
                s = s.withColumn("winner", F.when(F.col("_end"), F.col("_winner")).otherwise(F.col("winner"))).withColumn("done", F.col("done") | F.col("_end")).drop("_end", "_winner")
            if self.options.t_max is not None:
                s = s.withColumn("done", F.col("done") | (F.col("turn") > self.options.t_max))
            s = s.join(self._decided(rule, picked), "world_id", "left")
        s = written(s)
        if player:
            self._record(box, rule, s, path)
        self.log(self.events, s.select("world_id", F.lit(self.step).cast("long").alias("step"), F.lit(box.name).alias("box"), F.lit(rule.name).alias("rule"), F.col("_fired").alias("fired")))
        yes, no = self.label(outs[0]), self.label(outs[1])
        rows = s.select("world_id", F.when(F.col("_fired"), F.lit(yes)).otherwise(F.lit(no)).alias("wire"), "turn", "done", "winner")
        self.state = self.state.where(~self.place(inputs)).unionByName(rows)
        for w in inputs:
            for x, f in self.lies.pop(w, set()):
                for d in (False, True):
                    if f is None or f is d:
                        self.held.pop((x, d), None)
        for r in s.groupBy("_fired", "done").count().collect():
            self.held[yes if r["_fired"] else no, r["done"]] = r["count"]
        self.lies.setdefault(outs[0], set()).add((yes, None))
        self.lies.setdefault(outs[1], set()).add((no, None))
        self.unions += 1
        if self.unions % MOST_UNIONS == 0:
            self.state = written(self.state.coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        if player and self.options.snapshots:
            self.snapshots.append((self.step, self.world.tables))

    def rewrite(self, rule, chosen: DataFrame) -> None:
        """Apply the rule at the chosen matches; what it touches is checkpointed, and kept matches follow."""
        before = self.world
        change = rewriting.apply(rule, chosen, before)
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a union adds partitions each time
        wanted = {o: change.world.tables[o].coalesce(most) for o in change.world.schema.obs if o in change.deleted or o in change.inserted or o in change.updated}
        if change.deleted:
            wanted[""] = change.world.counters
        touched = checkpointed(wanted)
        self.world = replace(change.world, counters=touched.pop("", change.world.counters), tables=change.world.tables | touched)
        for name, cache in self.caches.items():
            if cache is not None:
                self.caches[name] = cache.updated(before, replace(change, world=self.world)).cut()

    # -- loops in one pass

    def sweeps(self, box: Any, wires: tuple[str, ...]) -> bool:
        """Are the firings of a box that is run again and again the legal matches of now, one by one in their order?
        They are for a rule that only plucks rows, where the first match is taken and nothing else can end the loop."""
        o = self.options
        if not isinstance(box, (RuleApp, PlayerRuleApp)) or box.rule.plucked is None or o.most_passes is not None:
            return False
        if any(self.held.get((x, True), 0) for w in wires for x, f in self.lies.get(w, ()) if f is not False):
            return False
        if isinstance(box, RuleApp):
            return True
        own = box.can_pass or box.take is not None or box.view_fn is not None or box.fast_match_fn is not None
        return not own and type(o.agents.get(box.player)) is First and o.t_max is None and o.terminal is None and not o.keep_legal

    def plucks(self, box: Any, wires: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """(world_id, part_id, _nth): the rows that a box would delete, numbered from 1 in each world; and the worlds
        with _k, how many that are."""
        here = self.on(wires)
        free = replace(box, match_limit=None) if isinstance(box, PlayerRuleApp) else box
        found, _ = self.candidates(free, self.worlds(here.select("world_id"), wires), here.select("world_id"), None)
        placed = ranked(found.select("world_id", tick(box.rule.plucked).alias("part_id")), ["world_id", "part_id"], "_at").checkpoint()
        ends = placed.groupBy("world_id").agg((F.min("_at") - 1).alias("_before"), F.count(F.lit(1)).alias("_k"))
        s = here.select("world_id", "turn", "done", "winner").join(ends, "world_id", "left").withColumns({"_k": F.coalesce("_k", F.lit(0).cast("long")), "_before": F.coalesce("_before", F.lit(0).cast("long"))}).checkpoint()
        return placed.join(s.select("world_id", "_before"), "world_id").select("world_id", "part_id", (F.col("_at") - F.col("_before")).alias("_nth")), s.drop("_before")

    def sweep(self, box: Any, wires: tuple[str, ...], out: str, path: tuple[str, ...], rows: DataFrame, s: DataFrame, fails: bool) -> None:
        """Delete the rows in one rewrite, and log what round after round would have: _nth is the round of a row, _k a
        world's rounds that fire. fails: one more round follows, in which nothing is found."""
        rule, player, base = box.rule, isinstance(box, PlayerRuleApp), self.step
        gone = rows.checkpoint()
        rounds = (s.agg(F.max("_k")).first()[0] or 0) + fails
        before, ob = self.world, rule.left.elements[rule.plucked]
        if rounds > fails:
            self.rewrite(rule, gone.select("world_id", F.col("part_id").alias(rule.plucked)))
            if self.options.log_changes:
                self.log(self.changes, gone.select("world_id", F.lit(ob).alias("ob"), "part_id", F.lit("delete").alias("change"), (F.col("_nth") + base).alias("step"), F.lit(box.name).alias("box")))
        self.step += rounds
        each = gone.select("world_id", F.col("_nth").alias("_round"), F.col("part_id").alias("_row")).join(s, "world_id")
        if fails:
            each = each.unionByName(s.withColumns({"_round": F.col("_k") + 1, "_row": F.lit(None).cast("long")}))
        each = each.withColumn("_fired", F.col("_row").isNotNull()).checkpoint()
        step = (F.col("_round") + base).alias("step")
        self.log(self.events, each.select("world_id", step, F.lit(box.name).alias("box"), F.lit(rule.name).alias("rule"), F.col("_fired").alias("fired")))
        if player:
            legal = F.col("_k") - F.col("_round") + 1
            given = each.withColumns({"turn": F.col("turn") + F.col("_round"), "_n": F.when(F.col("_fired"), F.lit(1)), "match": F.create_map(F.lit(rule.plucked), F.col("_row"))})
            given = given.withColumns({"legal": legal if box.match_limit is None else F.least(legal, F.lit(box.match_limit).cast("long")), "legal_actions": F.lit(None).cast("array<string>")})
            self._record(box, rule, given, path, step)
        label, turn = self.label(out), F.col("turn") + F.col("_k") + int(fails)
        there = s.select("world_id", F.lit(label).alias("wire"), (turn if player else F.col("turn")).alias("turn"), "done", "winner")
        rest = self.state.where(~self.place(wires))
        for w in wires:
            self.lies.pop(w, None)
        self.settle(rest.unionByName(there))
        if player and self.options.snapshots:
            marked = before.tables[ob].join(gone.select("world_id", "part_id", (F.col("_nth") + base).alias("_until")), ["world_id", "part_id"], "left").checkpoint()
            span = Span(before.tables, ob, marked, base + 1, self.step)
            self.snapshots += [(t, After(span, t)) for t in range(base + 1, self.step + 1)]

    def sweep_loop(self, x: Schedule, wires: tuple[str, ...], outs: tuple[str, ...], path: tuple[str, ...]) -> bool:
        """Run a loop in one pass, if that is the same."""
        found = lone(x)
        if found is None or not self.any_on(wires) or not self.sweeps(found[0], wires):
            return False
        rows, s = self.plucks(found[0], wires)
        self.sweep(found[0], wires, outs[x.exits.index(found[1])], (*path, x.name), rows, s, True)
        return True

    def sweep_while(self, box: While, wires: tuple[str, ...], out: str) -> bool:
        """The same for a body that plucks rows of the table that the test counts, one each round: a world goes on for
        as many rounds as it has rows too many."""
        rule = box.body.rule if isinstance(box.body, RuleApp) else None
        if rule is None or box.most is not None or not isinstance(box.test, MoreThan) or rule.plucked is None or rule.left.elements[rule.plucked] != box.test.ob or not self.sweeps(box.body, wires):
            return False
        rows, s = self.plucks(box.body, wires)
        many = self.world.table(box.test.ob).groupBy("world_id").agg(F.greatest(F.count(F.lit(1)) - F.lit(box.test.n), F.lit(0)).alias("_over"))
        s = s.join(many, "world_id", "left").withColumn("_over", F.coalesce("_over", F.lit(max(0, -box.test.n)).cast("long"))).checkpoint()
        if not s.where("_over > _k").isEmpty():
            # such a world stays above the number, without a match
            return False
        rows = rows.join(s.select("world_id", "_over"), "world_id").where("_nth <= _over").drop("_over")
        self.sweep(box.body, wires, out, (), rows, s.select("world_id", "turn", "done", "winner", F.col("_over").alias("_k")), False)
        return True

    @staticmethod
    def _as_map(rule) -> Column:
        names = list(rule.left.elements)
        return F.create_map(*[x for e in names for x in (F.lit(e), tick(e))]) if names else F.create_map().cast("map<string,bigint>")

    def _offered(self, rule, offered) -> DataFrame:
        """#world, #legal and, where they are to be kept, #actions of the worlds where something is offered."""
        kept = F.sort_array(F.collect_list(F.when(~F.col("passes"), F.to_json(self._as_map(rule))))) if self.options.keep_legal and rule.left.elements else F.lit(None).cast("array<string>")
        return offered.groupBy(F.col("world_id").alias("#world")).agg(F.count(F.lit(1)).alias("#legal"), kept.alias("#actions"))

    def _decided(self, rule, picked) -> DataFrame:
        """What was offered to each world, and what was chosen: world_id, legal, legal_actions, _n, match."""
        acted = F.when(~F.col("passes"), F.lit(1))
        one = F.first(F.when(~F.col("passes"), self._as_map(rule)), ignorenulls=True) if rule.left.elements else F.lit(None).cast("map<string,bigint>")
        found = picked.groupBy(F.col("#world").alias("world_id")).agg(F.first("#legal").alias("legal"), F.first("#actions").alias("legal_actions"), F.count(acted).alias("_n"), one.alias("match"))
        return found.withColumn("_n", F.when(F.col("_n") > 0, F.col("_n")))

    def _record(self, box, rule, s, path, step: Column | None = None) -> None:
        acted = F.col("_n").isNotNull()
        actions = F.transform("legal_actions", lambda j: F.from_json(j, "map<string,bigint>"))
        self.log(
            self.experiences,
            s.select(
                "world_id", F.lit(self.step).cast("long").alias("step") if step is None else step, F.lit(box.player).alias("player"), "turn", F.lit(box.name).alias("box"), F.lit(rule.name).alias("rule"), F.when(acted, F.lit(rule.name)).alias("action"), F.when(acted, F.col("match")).alias("match"),
                F.coalesce("legal", F.lit(0).cast("long")).alias("legal"), actions.alias("legal_actions"), "done", "winner", F.create_map().cast("map<string,string>").alias("info"), F.lit(list(path)).cast("array<string>").alias("schedule_path"),
            ),
        )

    def run_agents(self, box: AgentLoop, inputs, outs, here, path) -> None:
        names = tuple(box.interface.elements)
        agents = matching.match(box.interface, self.world.only(here)).select("world_id", *[tick(e) for e in names]).checkpoint()
        top = f"{'/'.join(path)}:{box.name}"
        if box.at_once:
            if not isinstance(box.body, (RuleApp, PlayerRuleApp)):
                raise TypeError(f"{box.name}: only a single rule can be applied for all agents at once")
            self.run_rule(box.body, inputs, [f"{top}+", f"{top}-"], here, (agents, names), (*path, box.name), at_once=True)
            self.rename({f"{top}+": outs[0], f"{top}-": outs[0]})
            return
        from pyspark.sql.window import Window

        w = Window.partitionBy("world_id").orderBy(*[tick(e) for e in names])
        ranked = agents.withColumn("_rank", F.row_number().over(w)).checkpoint()
        most = ranked.agg(F.max("_rank")).first()[0] or 0
        self.rename({w: f"{top}>" for w in inputs})
        for rank in range(1, most + 1):
            rows = ranked.where(F.col("_rank") == rank).drop("_rank")
            for e, o in box.interface.elements.items():
                # an agent may be gone by its turn
                t = self.world.table(o).select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"))
                rows = rows.join(t, (F.col("world_id") == F.col("_w")) & (tick(e) == F.col("_p")), "left_semi")
            active = self.on((f"{top}>",)).where(~F.col("done")).join(rows.select("world_id"), "world_id", "left_semi").select("world_id", F.lit(f"{top}!").alias("out"))
            self.move((f"{top}>",), active)
            self.run_body(box.body, (f"{top}!",), (f"{top}>",), (*path, box.name), (rows, names))
        self.rename({f"{top}>": outs[0]})

    # -- schedules

    def run_nested(self, x: Schedule, inputs, outs, path, pins) -> None:
        """A schedule as a box: its loop runs until all worlds have left it. Several input wires feed its inputs in
        order; one feeds the first."""
        top = f"{'/'.join((*path, x.name))}."
        starts = x.inputs or x.trace
        self.rename({w: top + starts[min(i, len(starts) - 1)] for i, w in enumerate(inputs)})
        self.loop(x, top, tuple(outs), path, pins)

    def loop(self, x: Schedule, top: str, outs: tuple[str, ...], path: tuple[str, ...], pins) -> None:
        start = tuple(top + w for w in (*x.trace, *x.inputs))
        if pins is None and self.sweep_loop(x, start, outs, path):
            return
        most = self.options.most_passes
        for turn in range(most) if most is not None else count():
            if turn:
                # what is done stays on its wire
                self.park(start)
            if not self.any_on(start):
                break
            for s in x.steps:
                self.run_box(x.boxes[s.box], tuple(top + w for w in s.inputs), tuple(top + w for w in s.outputs), (*path, x.name), pins)
            self.rename({top + r: top + t for r, t in zip(x.returns, x.trace)} | {top + r: outs[i] for i, r in enumerate(x.exits)})
            if not x.trace:
                break


def run(x: Schedule, world: World, agents: Mapping[str, Agent], t_max: int | None = None, terminal: Callable[[World], DataFrame] | None = None, win_conditions: Mapping[str, str | None] | None = None, seed: int = 0, **more) -> Result:
    """Run a schedule on every world of a batch.

    terminal: World -> DataFrame(world_id, done, winner), asked after each firing of a player. win_conditions: exit
    wire -> winner (None: a draw); where they are given, terminal isn't asked. t_max: turns of players, None for as
    many as it takes. most_passes: passes of each loop, likewise; a loop that nothing ends goes on for ever.
    A schedule with several inputs gets a copy of each world on each: ids world_id * inputs + place.
    """
    if win_conditions:
        terminal = None
    inputs = x.inputs or x.trace[:1]
    if len(inputs) > 1:
        n = len(inputs)
        copies = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_copy")
        tables = {o: t.select("*", copies).withColumn("world_id", F.col("world_id") * n + F.col("_copy")).drop("_copy") for o, t in world.tables.items()}
        world = replace(world, tables=tables, ids=world.ids.select("world_id", copies).select((F.col("world_id") * n + F.col("_copy")).alias("world_id")), one_world=False)
    r = Runner(world, Options(agents, t_max, terminal, seed, **more))
    top = f"{x.name}."
    place = F.pmod(F.col("world_id"), F.lit(len(inputs))).cast("int") if len(inputs) > 1 else F.lit(0)
    r.settle(r.state.withColumn("wire", F.element_at(F.array(*[F.lit(r.label(top + w)) for w in inputs]), place + 1)))
    exits = tuple(f"exit:{w}" for w in x.exits)
    r.loop(x, top, exits, (), None)
    wire = reduce(lambda acc, w: F.when(r.place((w,)), F.lit(w.removeprefix("exit:"))).otherwise(acc), exits, F.lit(None).cast("string"))
    control = r.state.select("world_id", "turn", "done", "winner", wire.alias("exit_wire"))
    if win_conditions:
        won = reduce(lambda acc, kv: F.when(F.col("exit_wire") == kv[0], F.lit(kv[1])).otherwise(acc), win_conditions.items(), F.col("winner"))
        control = control.withColumn("winner", won.cast("string"))
    # a world that has left by an exit is done
    control = control.withColumn("done", F.col("done") | F.col("exit_wire").isNotNull())
    spark = world.spark
    exp = reduce(DataFrame.unionByName, r.experiences) if r.experiences else spark.createDataFrame([], EXPERIENCE)
    if exits:
        # the last decision of a world knows how it ended
        last = exp.groupBy("world_id").agg(F.max("step").alias("_last"))
        ended = control.where("exit_wire is not null").select("world_id", F.col("winner").alias("_won"))
        exp = exp.join(last.join(ended, "world_id"), "world_id", "left").withColumn("_end", F.col("step") == F.col("_last"))
        exp = exp.withColumn("done", F.col("done") | F.coalesce("_end", F.lit(False))).withColumn("winner", F.when(F.col("_end"), F.coalesce("_won", "winner")).otherwise(F.col("winner"))).drop("_last", "_won", "_end")
    events = reduce(DataFrame.unionByName, r.events) if r.events else spark.createDataFrame([], EVENT)
    changes = reduce(DataFrame.unionByName, r.changes) if r.changes else None
    return Result(r.world, control, exp, events, r.snapshots, changes)


def interpret(x: Schedule, world: World, max_step: int = 10_000, seed: int = 0, **more) -> World:
    """The worlds after a schedule without players, of whose loops at most max_step passes are run."""
    return run(x, world, {}, seed=seed, most_passes=max_step, **more).world
