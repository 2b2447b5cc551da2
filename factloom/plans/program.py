"""Programs stored as ordered facts, lowered to Column expressions.

A program is a list of steps (opcode, operand), with the address and source of each if it was read from facts. Code
that only jumps forward becomes one expression over a whole population of inputs: it runs on a stack of Columns, each
step once, and paths that meet at a step are one from there on. Loops over 0..n-1 become higher-order functions.
Programs with a backward jump or recursion run in a machine that works on whole batches of rows: rows at the same
step move together, split at a branch and join where they meet again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS, MAX_DEPTH = 100_000, 256
ARITHMETIC = {"ADD", "SUB", "MUL", "DIV", "MOD", "AND", "OR", "XOR", "SHL", "SHR", "LT", "LE", "GT", "GE", "EQ", "NE"}
NEEDS = {"PUSH", "LOAD", "STORE", "FETCH", "OPAQUE", "FOLD", "MAP", "FILTER", "JMP", "JZ", "CALL", "DISPATCH"}
OPCODES = ARITHMETIC | NEEDS | {"NOT", "DUP", "POP", "SWAP", "EMIT", "RET"}
#: Parts of an expression, repeats counted, beyond which the machine is faster than planning it.
HEAVIEST = 3_000
#: Operations whose expression holds its operands more than once.
TWICE = {"DIV", "MOD", "AND", "OR", "XOR", "SHL", "SHR"}
Step = tuple


class ExecError(RuntimeError):
    """A program that is refused."""


class Unlowerable(Exception):
    """Code with a loop that no expression can hold."""


def program(facts: DataFrame, scope: str) -> list[Step]:
    """The steps of a scope in order: opcode, operand, address, source (a program is a few rows)."""
    rows = facts.where((F.col("scope") == scope) & F.col("seq").isNotNull()).orderBy("seq", "source_sentence_idx").select("relation", "object", "seq", "source_article")
    return [tuple(r) for r in rows.collect()]


def validate(steps: list[Step]) -> None:
    if not steps:
        raise ExecError("empty program")
    for op, arg, *_ in steps:
        if op not in OPCODES:
            raise ExecError(f"unknown opcode {op}")
        if op in NEEDS and arg in (None, ""):
            raise ExecError(f"{op} without an operand")
        if op == "PUSH":
            try:
                float(arg)
            except ValueError:
                raise ExecError(f"PUSH of no number: {arg}") from None


def resolved(steps: list[Step]) -> list[Step]:
    """Checked steps (opcode, operand, address, source); jumps lead to places in the list.

    An address is a step's own where it has one, else its place.
    """
    validate(steps)
    full = [(s[0], s[1], s[2] if len(s) > 2 else n, s[3] if len(s) > 3 else None) for n, s in enumerate(steps)]
    place = {s[2]: n for n, s in enumerate(full)}

    def jump(arg) -> int:
        try:
            return place[int(float(arg))]
        except (KeyError, ValueError):
            raise ExecError(f"jump to no address: {arg}") from None

    return [(op, jump(arg) if op in ("JMP", "JZ") else arg, at, source) for op, arg, at, source in full]


def table_of(arg: str) -> dict[int, str]:
    pairs = [x.partition(":") for x in arg.split(",") if x.strip()]
    try:
        table = {int(k): v.strip() for k, _, v in pairs}
    except ValueError:
        raise ExecError(f"DISPATCH with a selector that is no whole number: {arg}") from None
    if not table or not all(table.values()):
        raise ExecError(f"DISPATCH without a table: {arg}")
    return table


def refuse(why: str) -> Column:
    return F.raise_error(F.lit(why)).cast("double")


def whole(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("long")).otherwise(F.raise_error(F.lit("not an integer")).cast("long"))


def binary(op: str, a: Column, b: Column) -> Column:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    if op in ("ADD", "SUB", "MUL"):
        return {"ADD": a + b, "SUB": a - b, "MUL": a * b}[op]
    if op == "DIV":
        return F.when(b == 0, refuse("division by zero")).otherwise(a / b)
    if op == "MOD":
        return F.when(b == 0, refuse("modulo by zero")).otherwise(((a % b) + b) % b)
    if op in ("LT", "LE", "GT", "GE", "EQ", "NE"):
        return flag({"LT": a < b, "LE": a <= b, "GT": a > b, "GE": a >= b, "EQ": a == b, "NE": a != b}[op])
    x, y = whole(a), whole(b)
    if op in ("SHL", "SHR"):
        fine = (y >= 0) & (y < 63)
        shifted = F.call_function("shiftleft" if op == "SHL" else "shiftright", x, y.cast("int"))
        return F.when(fine, shifted.cast("double")).otherwise(refuse("shift out of range"))
    return {"AND": x.bitwiseAND(y), "OR": x.bitwiseOR(y), "XOR": x.bitwiseXOR(y)}[op].cast("double")


@dataclass
class Path:
    """Where a set of rows is: under which condition (None: all), with which stack and variables."""

    when: Column | None
    stack: list[Column]
    env: dict[str, Column]


def both(a: Column | None, b: Column) -> Column:
    """a and b; b is looked at only where a holds, as it may refuse elsewhere."""
    return b if a is None else F.when(a, b).otherwise(False)


class Lowering:
    def __init__(self, programs: dict[str, list[Step]], fetched: dict[str, Column], oracles: dict[str, Column]):
        self.programs, self.fetched, self.oracles = programs, fetched, oracles
        self.emitted: list[Column] = []
        self.weights: dict[int, tuple[Column, int]] = {}

    def weighed(self, made: Column, *parts: Column | None) -> Column:
        """made of the parts; an expression that repeats its parts too often is left to the machine."""
        n = 1 + sum(self.weights.get(id(p), (p, 1))[1] for p in parts if p is not None)
        if n > HEAVIEST:
            raise Unlowerable("too large an expression")
        self.weights[id(made)] = (made, n)
        return made

    def joined(self, a: Path, b: Path, name: str) -> Path:
        if len(a.stack) != len(b.stack):
            raise Unlowerable(name)
        pick = lambda x, y: x if x is y else self.weighed(F.when(a.when, x).otherwise(y), a.when, x, y)
        env = {k: pick(a.env[k], b.env[k]) for k in a.env if k in b.env}
        return Path(self.weighed(a.when | b.when, a.when, b.when), [pick(x, y) for x, y in zip(a.stack, b.stack)], env)

    def run(self, name: str, stack: list[Column], env: dict[str, Column], callers: tuple[str, ...] = (), when: Column | None = None) -> list[Column]:
        """The stack when the program returns."""
        if name in callers:
            raise Unlowerable(name)
        if name not in self.programs:
            raise ExecError(f"no program {name}")
        steps, callers, end = self.programs[name], (*callers, name), len(self.programs[name])
        waiting: dict[int, Path] = {0: Path(None, list(stack), dict(env))}

        def go(to: int, path: Path) -> None:
            waiting[to] = self.joined(waiting[to], path, name) if to in waiting else path

        for pc in range(end):  # jumps lead forward, so all paths to a step have come when it is reached
            if pc not in waiting:
                continue
            path = waiting.pop(pc)
            if not waiting:  # nobody is elsewhere
                path.when = None
            op, arg = steps[pc][:2]
            stack, env = path.stack, path.env

            def pop() -> Column:
                if not stack:
                    raise ExecError("stack underflow")
                return stack.pop()

            if op == "PUSH":
                stack.append(F.lit(float(arg)))
            elif op == "LOAD":
                if arg not in env:
                    raise ExecError(f"undefined variable {arg}")
                stack.append(env[arg])
            elif op == "STORE":
                env[arg] = pop()
            elif op in ARITHMETIC:
                b, a = pop(), pop()
                stack.append(self.weighed(binary(op, a, b), a, b, *([a, b] if op in TWICE else [])))
            elif op == "NOT":
                a = pop()
                stack.append(self.weighed((-(whole(a) + 1)).cast("double"), a, a))
            elif op == "DUP":
                stack.append(pop()), stack.append(stack[-1])
            elif op == "POP":
                pop()
            elif op == "SWAP":
                b, a = pop(), pop()
                stack += [b, a]
            elif op == "FETCH":
                stack.append(self.fetched[arg])
            elif op == "OPAQUE":
                stack.append(self.oracles[arg] if arg in self.oracles else refuse(f"no oracle for {arg}"))
            elif op == "EMIT":
                self.emit(F.array(stack[-1] if stack else F.lit(None).cast("double")), both(when, path.when) if path.when is not None else when)
            elif op in ("FOLD", "MAP", "FILTER"):
                self.loop(op, arg, stack, pop, callers, both(when, path.when) if path.when is not None else when)
            elif op == "CALL":
                path.stack = self.run(arg, stack, {}, callers, both(when, path.when) if path.when is not None else when)
            elif op == "DISPATCH":
                path.stack = self.dispatch(table_of(arg), pop(), stack, callers, both(when, path.when) if path.when is not None else when)
            elif op == "JMP":
                if arg <= pc:
                    raise Unlowerable(name)
                go(arg, path)
                continue
            elif op == "JZ":
                if arg <= pc:
                    raise Unlowerable(name)
                tested = pop()
                here, there = (self.weighed(both(path.when, c), path.when, tested) for c in (tested != 0, tested == 0))
                go(arg, Path(there, list(stack), dict(env)))
                go(pc + 1, Path(here, stack, env))
                continue
            elif op == "RET":
                go(end, path)
                continue
            go(pc + 1, path)
        return waiting[end].stack

    def emit(self, values: Column, when: Column | None) -> None:
        self.emitted.append(values if when is None else F.when(when, values).otherwise(F.array().cast("array<double>")))

    def dispatch(self, table: dict[int, str], which: Column, stack: list[Column], callers: tuple[str, ...], when: Column | None) -> list[Column]:
        """The stack of the chosen program; all must leave stacks of one height."""
        cases = {k: self.run(target, list(stack), {}, callers, both(when, which == float(k))) for k, target in table.items()}
        if len({len(x) for x in cases.values()}) != 1:
            raise Unlowerable("DISPATCH")
        out = []
        for n in range(len(next(iter(cases.values())))):
            each = None
            for k, case in cases.items():
                hit = (which == float(k), case[n])
                each = F.when(*hit) if each is None else each.when(*hit)
            out.append(self.weighed(each.otherwise(refuse("no entry for the selector")), *[which] * len(cases), *(case[n] for case in cases.values())))
        return out

    def loop(self, op: str, scope: str, stack: list[Column], pop, callers: tuple[str, ...], when: Column | None) -> None:
        if op == "FOLD":
            n, acc = pop(), pop()
            items = self.indices(n)
            # an element without a result leaves the accumulator as it is
            stack.append(F.aggregate(items, acc, lambda a, i: (self.inner(scope, {"acc": a, "i": i}, callers) or [a])[-1]))
            return
        items = self.indices(pop())
        each = lambda i: (self.inner(scope, {"i": i}, callers) or [F.lit(None).cast("double")])[-1]
        out = F.transform(items, each) if op == "MAP" else F.filter(items, lambda i: F.coalesce(each(i) != 0, F.lit(False)))
        self.emit(out, when)
        stack.append(F.size(out).cast("double"))

    def inner(self, scope: str, env: dict[str, Column], callers: tuple[str, ...]) -> list[Column]:
        """An element's run; what it emits itself is not kept."""
        kept, self.emitted = self.emitted, []
        try:
            return self.run(scope, [], env, callers)
        finally:
            self.emitted = kept

    @staticmethod
    def indices(n: Column) -> Column:
        n = F.when(n < 0, F.raise_error(F.lit("negative count")).cast("long")).otherwise(whole(n))
        return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: i.cast("double"))


@dataclass
class Herd:
    """Rows at the same step of the same calls."""

    frames: list[tuple[str, int]]
    envs: list[dict[str, np.ndarray]]
    stack: list[np.ndarray]
    rows: np.ndarray
    steps: np.ndarray

    @property
    def key(self) -> tuple:
        return tuple(self.frames), len(self.stack), tuple(tuple(sorted(e)) for e in self.envs)

    def of(self, mask: np.ndarray) -> Herd:
        return Herd(list(self.frames), [{k: v[mask] for k, v in e.items()} for e in self.envs], [x[mask] for x in self.stack], self.rows[mask], self.steps[mask])

    def with_(self, other: Herd) -> Herd:
        cat = lambda a, b: np.concatenate([a, b])
        envs = [{k: cat(v, f[k]) for k, v in e.items()} for e, f in zip(self.envs, other.envs)]
        return Herd(self.frames, envs, [cat(a, b) for a, b in zip(self.stack, other.stack)], cat(self.rows, other.rows), cat(self.steps, other.steps))


@dataclass
class Machine:
    """Runs programs over batches of rows with budgets on steps and calls; frames share the stack, not the variables.

    fetched: operand of FETCH -> number or one number a row; oracles: label -> number. What is emitted comes as
    (rows, values) in the order of time. With ``trace`` a line is kept for each step (for single rows).
    """

    programs: dict[str, list[Step]]
    fetched: dict[str, float | np.ndarray] = field(default_factory=dict)
    oracles: dict[str, float] = field(default_factory=dict)
    trace: list[str] | None = None
    reads: list[str] = field(default_factory=list)
    opaque: list[str] = field(default_factory=list)
    emitted: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    cited: dict[str, str] = field(default_factory=dict)

    def run(self, name: str, env: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The top of the stack at the end, whether there is one, and the steps taken, by place in ``rows``."""
        value, there, steps = np.full(len(rows), np.nan), np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        place = {int(r): n for n, r in enumerate(rows)} if len(rows) and rows[-1] != len(rows) - 1 else None
        start = Herd([(name, 0)], [dict(env)], [], rows, steps.copy())
        waiting = {start.key: start}
        while waiting:
            # the deepest first, then the earliest step: rows that left a loop wait for those still in it
            herd = waiting.pop(max(waiting, key=lambda k: (len(k[0]), -k[0][-1][1])))
            for out in self.advance(herd):
                if out.frames:
                    k = out.key
                    waiting[k] = waiting[k].with_(out) if k in waiting else out
                    continue
                at = out.rows if place is None else np.array([place[int(r)] for r in out.rows])
                steps[at] = out.steps
                if out.stack:
                    value[at], there[at] = out.stack[-1], True
        return value, there, steps

    def advance(self, herd: Herd) -> list[Herd]:
        """Steps up to the next branch, call or return."""
        scope, pc = herd.frames[-1]
        if scope not in self.programs:
            raise ExecError(f"no program {scope}")
        code, env, stack = self.programs[scope], herd.envs[-1], herd.stack

        def pop() -> np.ndarray:
            if not stack:
                raise ExecError("stack underflow")
            return stack.pop()

        while pc < len(code):
            op, arg, address, source = code[pc]
            pc += 1
            herd.steps = herd.steps + 1
            if herd.steps.max(initial=0) > MAX_STEPS:
                raise ExecError("too many steps")
            out = None
            if op == "PUSH":
                stack.append(np.full(len(herd.rows), float(arg)))
            elif op == "LOAD":
                if arg not in env:
                    raise ExecError(f"undefined variable {arg}")
                stack.append(env[arg])
            elif op == "STORE":
                env[arg] = pop()
            elif op in ARITHMETIC:
                b, a = pop(), pop()
                stack.append(calculate(op, a, b))
            elif op == "NOT":
                stack.append((~integers(pop())).astype(float))
            elif op == "DUP":
                stack += [x := pop(), x]
            elif op == "POP":
                pop()
            elif op == "SWAP":
                b, a = pop(), pop()
                stack += [b, a]
            elif op == "FETCH":
                stack.append(self.fetch(arg, env, herd.rows))
            elif op == "OPAQUE":
                if arg not in self.oracles:
                    raise ExecError(f"no oracle for {arg}")
                stack.append(np.full(len(herd.rows), float(self.oracles[arg])))
                self.opaque.append(f"{arg} = {float(self.oracles[arg])} [OPAQUE, unverified]")
            elif op == "EMIT":
                self.emitted.append((herd.rows, stack[-1] if stack else np.full(len(herd.rows), np.nan)))
            elif op in ("FOLD", "MAP", "FILTER"):
                self.repeat(op, arg, herd, pop)
            elif op in ("CALL", "DISPATCH"):
                herd.frames[-1] = (scope, pc)
                which = None if op == "CALL" else integers(pop())
                if len(herd.frames) >= MAX_DEPTH:
                    raise ExecError("calls too deep")
                table = {None: arg} if which is None else table_of(arg)
                if which is not None and not np.isin(which, list(table)).all():
                    raise ExecError("no entry for the selector")
                out = [herd.of(slice(None) if k is None else which == k) for k in table if k is None or (which == k).any()]
                for h, target in zip(out, [t for k, t in table.items() if k is None or (which == k).any()]):
                    h.frames.append((target, 0)), h.envs.append({})
            elif op == "JMP":
                herd.frames[-1] = (scope, arg)
                out = [herd]
            elif op == "JZ":
                zero = pop() == 0
                out = [h for h in (herd.of(zero), herd.of(~zero)) if len(h.rows)]
                for h, to in zip(out, [x for x, some in ((arg, zero.any()), (pc, not zero.all())) if some]):
                    h.frames[-1] = (scope, to)
            if self.trace is not None:
                self.trace.append(f"@{address}: {op}{'' if arg in (None, '') else f' {arg}'}   stack={[float(x[0]) for x in stack]}   [{source}]")
            if op == "RET":
                break
            if out is not None:
                return out
        herd.frames.pop(), herd.envs.pop()
        return [herd]

    def fetch(self, arg: str, env: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        if arg not in self.fetched:
            raise ExecError(f"no fact {arg}")
        x = self.fetched[arg]
        if arg in self.cited:
            self.reads.append(self.cited[arg])
        return np.full(len(rows), float(x)) if np.isscalar(x) else x[rows]

    def repeat(self, op: str, scope: str, herd: Herd, pop) -> None:
        n = integers(pop())
        if (n < 0).any():
            raise ExecError("negative count")
        acc = pop().copy() if op == "FOLD" else np.zeros(len(n))
        for i in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > i)
            here = np.full(len(on), float(i))
            kept, self.emitted = self.emitted, []
            value, there, taken = self.run(scope, {"acc": acc[on], "i": here} if op == "FOLD" else {"i": here}, herd.rows[on])
            self.emitted = kept
            herd.steps[on] += taken + 1
            if op == "FOLD":
                acc[on] = np.where(there, value, acc[on])
            else:
                keep = np.ones(len(on), bool) if op == "MAP" else there & (value != 0)
                self.emitted.append((herd.rows[on[keep]], np.where(there, value, np.nan)[keep] if op == "MAP" else here[keep]))
                acc[on] += keep
        herd.stack.append(acc)

    def lists(self, n: int) -> list[list[float | None]]:
        """What each row emitted, in order."""
        out: list[list[float | None]] = [[] for _ in range(n)]
        for rows, values in self.emitted:
            for r, v in zip(rows.tolist(), values.tolist()):
                out[r].append(None if v != v else v)
        return out


def integers(x: np.ndarray) -> np.ndarray:
    if (x != np.floor(x)).any():
        raise ExecError("not an integer")
    return x.astype(np.int64)


def calculate(op: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if op in ("DIV", "MOD") and (b == 0).any():
        raise ExecError("division by zero")
    if op in ("AND", "OR", "XOR", "SHL", "SHR"):
        x, y = integers(a), integers(b)
        if op in ("SHL", "SHR") and ((y < 0) | (y > 62)).any():
            raise ExecError("shift out of range")
        f = {"AND": np.bitwise_and, "OR": np.bitwise_or, "XOR": np.bitwise_xor, "SHL": np.left_shift, "SHR": np.right_shift}[op]
        return f(x, y).astype(float)
    f = {"ADD": np.add, "SUB": np.subtract, "MUL": np.multiply, "DIV": np.divide, "MOD": np.mod, "LT": np.less, "LE": np.less_equal, "GT": np.greater, "GE": np.greater_equal, "EQ": np.equal, "NE": np.not_equal}[op]
    return f(a, b).astype(float)


def surface(programs: dict[str, list[Step]], opcode: str) -> list[str]:
    """The operands of an opcode: FETCH for what the programs read, OPAQUE for what they take on trust, CALL for whom they call."""
    return sorted({arg for steps in programs.values() for op, arg, *_ in steps if op == opcode})


def fetches(programs: dict[str, list[Step]]) -> list[str]:
    """What the programs read: subject|relation of every FETCH."""
    return surface(programs, "FETCH")


def run_program(df: DataFrame, programs: dict[str, list[Step]], name: str, inputs: list[str], out: str = "value", facts: DataFrame | None = None, oracles: dict[str, float] | None = None, emits: str | None = None) -> DataFrame:
    """df with the program's result for every row; its inputs are columns of the same names.

    FETCH reads the first fact of a subject and relation: a literal for a named subject, a join for ``@input``.
    ``emits``: a column for what the program emits, in order.
    """
    programs = {k: resolved(steps) for k, steps in programs.items()}
    fetched: dict[str, Column] = {}
    wanted, numbers = fetches(programs), {}
    if wanted:
        first = facts.groupBy("subject", "relation").agg(F.min_by("object", "triple_id").alias("object"))
        fixed = [w.split("|", 1) for w in wanted if not w.startswith("@")]
        if fixed:
            named = reduce(lambda a, b: a | b, [(F.col("subject") == s) & (F.col("relation") == r) for s, r in fixed])
            numbers = {f"{r[0]}|{r[1]}": float(r[2]) for r in first.where(named).collect()}  # as many as the program names
            fetched.update({"|".join(k): F.lit(numbers["|".join(k)]) if "|".join(k) in numbers else refuse(f"no fact {'|'.join(k)}") for k in fixed})
        for n, w in enumerate(w for w in wanted if w.startswith("@")):
            column, relation = w[1:].split("|", 1)
            look = first.where(F.col("relation") == relation).select(F.col("subject").alias(f"_s{n}"), F.col("object").alias(f"_o{n}"))
            df = df.join(look, F.col(column).cast("string") == F.col(f"_s{n}"), "left").drop(f"_s{n}")
            value = F.expr(f"try_cast(_o{n} as double)")
            fetched[w] = F.when(value.isNull(), refuse(f"no number for {w}")).otherwise(value)
    low = Lowering(programs, fetched, {k: F.lit(float(v)) for k, v in (oracles or {}).items()})
    looked = [f"_o{n}" for n in range(sum(w.startswith("@") for w in wanted))]
    try:
        stack = low.run(name, [], {c: F.col(c).cast("double") for c in inputs})
        result = df.withColumn(out, stack[-1] if stack else F.lit(None).cast("double"))
        if emits:
            result = result.withColumn(emits, F.concat(*low.emitted) if low.emitted else F.array().cast("array<double>"))
        return result.drop(*looked)
    except Unlowerable:
        known, joined_in = {k: float(v) for k, v in (oracles or {}).items()}, [w for w in wanted if w.startswith("@")]

        @F.pandas_udf("value double, emitted array<double>")
        def machine(frame: pd.DataFrame) -> pd.DataFrame:
            n = len(frame)
            columns = [frame.iloc[:, k].to_numpy(float) for k in range(frame.shape[1])]
            m = Machine(programs, {**numbers, **dict(zip(joined_in, columns[len(inputs) :]))}, known)
            value, there, _ = m.run(name, dict(zip(inputs, columns)), np.arange(n))
            return pd.DataFrame({"value": [v if t else None for v, t in zip(value.tolist(), there)], "emitted": m.lists(n)})

        given = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(inputs)] + [fetched[w].alias(f"f{k}") for k, w in enumerate(joined_in)]
        result = df.withColumn("_ran", machine(F.struct(*given) if given else F.struct(F.lit(0.0).alias("none"))))
        result = result.withColumn(out, F.col("_ran.value"))
        return (result.withColumn(emits, F.col("_ran.emitted")) if emits else result).drop("_ran", *looked)


@dataclass(frozen=True)
class Outcome:
    """A single run with its provenance: a line for each step, the facts read, the values taken on trust."""

    value: float | None
    trace: list[str]
    steps: int
    outputs: list[float | None]
    reads: list[str]
    opaque: list[str]


def execute(facts: DataFrame, scope: str, inputs: dict[str, float | str] | None = None, oracles: dict[str, float] | None = None) -> Outcome:
    """One run of a stored program on the driver (for whole populations: `run_program`).

    A text input is an entity: ``FETCH @input|relation`` reads its facts.
    """
    given, programs, todo = dict(inputs or {}), {}, [scope]
    while todo:
        name = todo.pop()
        if name in programs:
            continue
        programs[name] = resolved(program(facts, name))
        for op, arg, *_ in programs[name]:
            todo += [arg] if op in ("CALL", "FOLD", "MAP", "FILTER") else list(table_of(arg).values()) if op == "DISPATCH" else []
    fetched, cited = {}, {}
    for w in fetches(programs):
        subject, mark, relation = w.partition("|")
        if not mark:
            raise ExecError(f"FETCH of no subject and relation: {w}")
        subject = str(given.get(subject[1:], subject)) if subject.startswith("@") else subject
        row = facts.where((F.col("subject") == subject) & (F.col("relation") == relation)).orderBy("triple_id").select("object", "source_article").head()
        try:
            fetched[w] = float(row[0]) if row else None
        except ValueError:
            raise ExecError(f"no number: {subject} {relation} {row[0]}") from None
        cited[w] = f"{subject} {relation} {row[0]} [{row[1]}]" if row else ""
    machine = Machine(programs, {k: v for k, v in fetched.items() if v is not None}, oracles or {}, trace=[], cited=cited)
    numbers = {}
    for k, v in given.items():
        try:
            numbers[k] = np.array([float(v)])
        except ValueError:
            continue
    value, there, steps = machine.run(scope, numbers, np.arange(1))
    return Outcome(float(value[0]) if there[0] else None, machine.trace, int(steps[0]), machine.lists(1)[0], machine.reads, machine.opaque)


def call_value(df: DataFrame, programs: dict[str, list[Step]], name: str, arguments: list[str], out: str = "value", **more) -> DataFrame:
    """`run_program` for a program that takes its arguments from the stack, last on top."""
    driver = [("LOAD", c) for c in arguments] + [("CALL", name), ("RET", "")]
    return run_program(df, {**programs, "(call)": driver}, "(call)", arguments, out, **more)


def score_flags(facts: DataFrame, programs: dict[str, list[Step]], name: str, relations: dict[str, str], flag: float = 1.0) -> DataFrame:
    """Subjects that a program flags; its inputs are the first objects of relations (input -> relation) as numbers."""
    first = facts.where(F.col("relation").isin(list(relations.values()))).groupBy("subject", "relation").agg(F.min_by("object", "triple_id").alias("object"))
    wide = first.groupBy("subject").pivot("relation", sorted(set(relations.values()))).agg(F.first("object"))
    ready = wide.select("subject", *(F.expr(f"try_cast(`{r}` as double)").alias(i) for i, r in relations.items())).dropna()
    return run_program(ready, programs, name, list(relations), facts=facts).where(F.col("value") == flag).select("subject")


def triples_of(name: str, steps: list[Step]) -> list[dict]:
    """Rows of facts that hold a program."""
    return [{"subject": name, "relation": op, "object": arg or "", "source_article": "program", "source_sentence_idx": i, "scope": name, "seq": more[0] if more else i} for i, (op, arg, *more) in enumerate(steps)]
