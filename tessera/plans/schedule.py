"""Schedules: boxes wired to one another, read from a small language.

    a, b = move(start)
    c = merge(a, [b, other])
    return c, a

Each line sends worlds from wires through a box to wires; a call within a call gets a wire of its own. The first
wires that are returned lead back to the start of the loop, the others are exits.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from tessera.pattern import Pattern
from tessera.rule import Rule, adding


@dataclass(frozen=True)
class RuleApp:
    """Applies a rule at its first legal match, without a player. Outputs: applied, not applied."""

    name: str
    rule: Rule
    in_hom: Mapping[str, str] = field(default_factory=dict)
    outputs = 2


@dataclass(frozen=True)
class PlayerRuleApp:
    """A player chooses where a rule is applied. Outputs: applied, not applied (no match, or a pass).

    in_hom: element of an agent's interface -> element of the rule's left side, held fixed in agent loops.
    match_limit: only the first so many legal matches are offered. take: so many of them by a draw, or a function of
    (step, name) giving that. view_fn: what the player sees of a world. fast_match_fn: (rule, world) -> matches, in
    place of the search. can_pass: passing is offered beside at least one match. use_cache: keep the matches between
    firings and search only around what changed.
    """

    name: str
    rule: Rule
    player: str
    in_hom: Mapping[str, str] = field(default_factory=dict)
    out_hom: Mapping[str, str] = field(default_factory=dict)
    can_pass: bool = False
    match_limit: int | None = None
    take: int | Callable[[int, str], int] | None = None
    view_fn: Callable | None = None
    fast_match_fn: Callable | None = None
    use_cache: bool = False
    outputs = 2


@dataclass(frozen=True)
class Query:
    """Looks whether a pattern occurs. Outputs: yes, no."""

    name: str
    pattern: Pattern
    monic: Any = False
    outputs = 2


@dataclass(frozen=True)
class Merge:
    """Several wires into one."""

    name: str = "merge"
    inputs: int = 2
    outputs = 1


@dataclass(frozen=True)
class Coin:
    """Output 1 with probability p, else 2."""

    name: str
    p: float
    outputs = 2

    def __post_init__(self):
        if not 0 <= self.p <= 1:
            raise ValueError(f"{self.p} is no probability")


@dataclass(frozen=True)
class Split:
    """One of several outputs, drawn by weight."""

    name: str
    weights: tuple[float, ...]

    @property
    def outputs(self) -> int:
        return len(self.weights)


@dataclass(frozen=True)
class Weaken:
    """Passes worlds on as they are."""

    name: str = "id"
    outputs = 1


@dataclass(frozen=True)
class MoreThan:
    """A test of While: the worlds with more than n rows of a table."""

    ob: str
    n: int

    def __call__(self, world):
        return world.nparts(self.ob).where(f"n > {self.n}").select("world_id")


@dataclass(frozen=True)
class While:
    """Runs its body while a test holds; test: World -> DataFrame(world_id) of worlds that go on.

    most: passes at most, None for as many as it takes. A pass of native rules in which none fires is the last, since
    all that follow would be like it.
    """

    name: str
    body: Any
    test: Callable
    most: int | None = None
    outputs = 1


@dataclass(frozen=True)
class AgentLoop:
    """Runs its body once for each match of the interface, which the body's rules hold fixed through in_hom.

    One after another in canonical order, or, for a single rule, all at once: then every agent chooses on the world
    as it was at the start, and of choices that contend the first agent's stands.
    """

    name: str
    interface: Pattern
    body: Any
    at_once: bool = False
    outputs = 1


@dataclass(frozen=True)
class Step:
    box: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


@dataclass(frozen=True)
class Schedule:
    """trace and inputs: wires at the start of a pass. The first len(trace) of `returns` lead back to trace."""

    name: str
    trace: tuple[str, ...]
    inputs: tuple[str, ...]
    boxes: Mapping[str, Any]
    steps: tuple[Step, ...]
    returns: tuple[str, ...]
    body: str = ""

    @property
    def outputs(self) -> int:
        return len(self.returns) - len(self.trace)

    @property
    def exits(self) -> tuple[str, ...]:
        return self.returns[len(self.trace) :]


def parse(body: str) -> tuple[tuple[Step, ...], tuple[str, ...]]:
    """Steps and returned wires of a body."""
    import textwrap

    steps: list[Step] = []
    returns: tuple[str, ...] = ()
    count = 0

    def names(node) -> tuple[str, ...]:
        if isinstance(node, ast.Name):
            return (node.id,)
        if isinstance(node, (ast.Tuple, ast.List)):
            return tuple(x for e in node.elts for x in names(e))
        raise SyntaxError(f"no wire: {ast.unparse(node)}")

    def inputs(node) -> tuple[str, ...]:
        nonlocal count
        if isinstance(node, ast.Name):
            return (node.id,)
        if isinstance(node, (ast.Tuple, ast.List)):
            return tuple(x for e in node.elts for x in inputs(e))
        if isinstance(node, ast.Call):
            count += 1
            wire = f"_gstmp_{count}"
            call(node, (wire,))
            return (wire,)
        raise SyntaxError(f"no wire: {ast.unparse(node)}")

    def call(node, out):
        if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
            raise SyntaxError(f"no box: {ast.unparse(node)}")
        given = tuple(x for a in node.args for x in inputs(a))
        steps.append(Step(node.func.id, given, out))

    tree = ast.parse("def _body():\n" + textwrap.indent(textwrap.dedent(body).strip() or "pass", "    "))
    for line in tree.body[0].body:
        if isinstance(line, ast.Assign) and len(line.targets) == 1:
            if isinstance(line.value, ast.Call):
                call(line.value, names(line.targets[0]))
            else:
                raise SyntaxError(f"no call: {ast.unparse(line)}")
        elif isinstance(line, ast.Return):
            if line.value is not None:
                returns = names(line.value)
        elif isinstance(line, ast.Expr) and isinstance(line.value, ast.Call):
            call(line.value, ())
        elif not isinstance(line, ast.Pass):
            raise SyntaxError(f"not a line of a schedule: {ast.unparse(line)}")
    return tuple(steps), returns


def schedule(name: str, trace: Iterable[str], inputs: Iterable[str], boxes: Mapping[str, Any], body: str) -> Schedule:
    """A schedule from its body; boxes by the names that the body calls them."""
    trace, inputs = tuple(trace), tuple(inputs)
    steps, returns = parse(body)
    made, read = set(trace) | set(inputs), set()
    for s in steps:
        if s.box not in boxes:
            raise ValueError(f"{name}: no box {s.box}")
        box = boxes[s.box]
        if len(s.outputs) > box.outputs:
            raise ValueError(f"{name}: {s.box} has {box.outputs} outputs")
        for w in s.inputs:
            if w not in made:
                raise ValueError(f"{name}: wire {w} comes from nowhere")
            if w in read:
                raise ValueError(f"{name}: wire {w} is read twice")
            read.add(w)
        if twice := made & set(s.outputs):
            raise ValueError(f"{name}: wire {sorted(twice)[0]} is made twice")
        made |= set(s.outputs)
    for w in returns:
        if w not in made or w in read:
            raise ValueError(f"{name}: wire {w} can't be returned")
    if len(returns) < len(trace):
        raise ValueError(f"{name}: {len(trace)} wires loop, {len(returns)} are returned")
    return Schedule(name, trace, inputs, dict(boxes), steps, returns, body)


def _wrapped(x: Any) -> tuple[Any, int]:
    return x, x.outputs


def create(name: str, pattern: Pattern) -> RuleApp:
    """A box that adds the pattern's rows to a world, whatever is there."""
    return RuleApp(name, adding(name, Pattern(pattern.schema), pattern))


def tryrule(x: Any, name: str | None = None) -> Schedule:
    """x, whether it succeeds or not."""
    n = x.outputs
    outs = [f"o{i}" for i in range(n)]
    return schedule(name or f"try_{x.name}", [], ["i"], {"x": x, "merge": Merge(inputs=n)}, f"{', '.join(outs)} = x(i)\nr = merge({', '.join(outs)})\nreturn r")


def then(a: Any, b: Any, name: str | None = None) -> Schedule:
    """a, then b on what succeeded; failures of rules are merged, other outputs of a feed b in order."""
    if isinstance(a, (RuleApp, PlayerRuleApp)) and isinstance(b, (RuleApp, PlayerRuleApp)):
        return schedule(name or f"{a.name}_{b.name}", [], ["i"], {"a": a, "b": b, "merge": Merge()}, "s, f = a(i)\nt, g = b(s)\nr = merge(f, g)\nreturn t, r")
    outs, ends = [f"w{i}" for i in range(a.outputs)], [f"e{i}" for i in range(b.outputs)]
    wanted = len(b.inputs) if isinstance(b, Schedule) else 1
    if len(outs) != wanted:
        raise ValueError(f"{a.name} has {len(outs)} outputs, {b.name} {wanted} inputs")
    return schedule(name or f"{a.name}_{b.name}", [], ["i"] if not isinstance(a, Schedule) else list(a.inputs), {"a": a, "b": b}, f"{', '.join(outs)} = a({'i' if not isinstance(a, Schedule) else ', '.join(a.inputs)})\n{', '.join(ends)} = b({', '.join(outs)})\nreturn {', '.join(ends)}")


def tensor(a: Any, b: Any, name: str | None = None) -> Schedule:
    """a and b side by side: two inputs; outputs are both successes, then both failures."""
    if a.outputs != 2 or b.outputs != 2:
        raise ValueError("both sides need a success and a failure")
    return schedule(name or f"{a.name}_and_{b.name}", [], ["i1", "i2"], {"a": a, "b": b}, "s1, f1 = a(i1)\ns2, f2 = b(i2)\nreturn s1, s2, f1, f2")


def boxes_of(x: Any, kind: type) -> list[Any]:
    """All boxes of a kind in a schedule, nested ones included, in the order of their steps."""
    if isinstance(x, Schedule):
        return [b for s in x.steps for b in boxes_of(x.boxes[s.box], kind)]
    found = [x] if isinstance(x, kind) else []
    return found + (boxes_of(x.body, kind) if isinstance(x, (AgentLoop, While)) else [])


def lone(x: Schedule) -> tuple[Any, str] | None:
    """The rule's box of a loop that has no other and goes round while the rule is applied, and the exit wire that
    worlds leave by when it isn't."""
    rules = [(x.boxes[s.box], s) for s in x.steps if not isinstance(x.boxes[s.box], (Merge, Weaken))]
    if len(rules) != 1 or not isinstance(rules[0][0], (RuleApp, PlayerRuleApp)) or len(rules[0][1].outputs) != 2 or not x.trace:
        return None
    box, step = rules[0]
    leads = {w: s.outputs[0] for s in x.steps if s is not step and s.outputs for w in s.inputs}

    def end(w: str) -> str:
        while w in leads:
            w = leads[w]
        return w

    starts = {end(w) for w in (*x.trace, *x.inputs)}
    yes, no = map(end, step.outputs)
    if not starts <= set(step.inputs) or yes not in x.returns[: len(x.trace)] or no not in x.exits:
        return None
    return box, no


def players(x: Any) -> list[PlayerRuleApp]:
    return boxes_of(x, PlayerRuleApp)


def right_sides(x: Any) -> list[Pattern]:
    """The right sides of all rules of a schedule."""
    return [b.rule.right for b in boxes_of(x, (RuleApp, PlayerRuleApp))]


def mapped(x: Any, rule: Callable[[Rule], Rule], pattern: Callable[[Pattern], Pattern], player: Callable[[str], str], name: Callable[[str], str] = lambda n: n, table: Callable[[str], str] = lambda o: o) -> Any:
    """A schedule with other rules, patterns, players, box names and tables that tests count; all other options stay."""
    if isinstance(x, Schedule):
        return replace(x, name=name(x.name), boxes={k: mapped(b, rule, pattern, player, name, table) for k, b in x.boxes.items()})
    if isinstance(x, PlayerRuleApp):
        return replace(x, name=name(x.name), rule=rule(x.rule), player=player(x.player))
    if isinstance(x, RuleApp):
        return replace(x, name=name(x.name), rule=rule(x.rule))
    if isinstance(x, Query):
        return replace(x, name=name(x.name), pattern=pattern(x.pattern))
    if isinstance(x, AgentLoop):
        return replace(x, name=name(x.name), interface=pattern(x.interface), body=mapped(x.body, rule, pattern, player, name, table))
    if isinstance(x, While):
        test = replace(x.test, ob=table(x.test.ob)) if isinstance(x.test, MoreThan) else x.test
        return replace(x, name=name(x.name), body=mapped(x.body, rule, pattern, player, name, table), test=test)
    return x


def dot(x: Schedule) -> str:
    """The schedule as a Graphviz graph."""
    lines = [f'digraph "{x.name}" {{', "  rankdir=LR;"]
    source: dict[str, str] = {}
    for w in (*x.trace, *x.inputs):
        lines.append(f'  "in_{w}" [shape=point];')
        source[w] = f"in_{w}"
    for i, s in enumerate(x.steps):
        lines.append(f'  "s{i}" [shape=box, label="{getattr(x.boxes[s.box], "name", s.box)}"];')
        lines += [f'  "{source[w]}" -> "s{i}" [label="{w}"];' for w in s.inputs]
        source |= {w: f"s{i}" for w in s.outputs}
    for i, w in enumerate(x.returns):
        end = f"in_{x.trace[i]}" if i < len(x.trace) else f"out_{w}"
        if i >= len(x.trace):
            lines.append(f'  "{end}" [shape=point];')
        lines.append(f'  "{source[w]}" -> "{end}" [label="{w}"{", style=dashed" if i < len(x.trace) else ""}];')
    return "\n".join([*lines, "}"])
