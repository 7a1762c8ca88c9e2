"""Spreadsheet formulas: a Pratt parser, an evaluator for whole sheets, and sheets as rows (sheet, row, col, input).

Values are None (empty), float, str, bool and Err. A sheet is evaluated in one group, since any cell may refer to any other;
sheets are bounded by MOST_CELLS and evaluated in parallel. After edits only what depends on them is worked out again.
"""

from __future__ import annotations

import functools
import math
import re
import statistics
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_CELLS = 600_000
MOST_RANGE = 500_000
ALONE = (-1, -1)


class Err(str):
    """An error value such as #DIV/0!."""


VALUE, DIV, NAME, NUM, NA, CIRCULAR = (Err(x) for x in ("#VALUE!", "#DIV/0!", "#NAME?", "#NUM!", "#N/A", "#CIRCULAR!"))


class Syntax(Exception):
    pass


TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|\"(?P<str>(?:[^\"]|\"\")*)\"|(?P<id>[A-Za-z_$][A-Za-z0-9_$.]*)|(?P<op><>|<=|>=|[-+*/^&=<>%(),:])|(?P<end>$))")
ADDRESS = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9]\d{0,6})\Z")
#: Left binding powers; the right side of ^ is read at the power of a sign, and % binds less than ^.
POWERS = {"=": 10, "<>": 10, "<": 10, ">": 10, "<=": 10, ">=": 10, "&": 20, "+": 30, "-": 30, "*": 40, "/": 40, "%": 60, "^": 70}
SIGN = 50


def address(text: str) -> tuple[int, int] | None:
    """(row, column) from 0 on, or None."""
    m = ADDRESS.match(text)
    if not m:
        return None
    column = functools.reduce(lambda a, x: a * 26 + ord(x) - 64, m[1].upper(), 0)
    return int(m[2]) - 1, column - 1


def column_label(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise Syntax(text[at:])
        if m.lastgroup != "end":
            out.append((m.lastgroup, m[m.lastgroup].replace('""', '"') if m.lastgroup == "str" else m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


#: Trees of formulas that a worker keeps, none of a longer text: sheets that are alike repeat their formulas.
MOST_TREES, LONGEST_KEPT = 4096, 256


def tree(text: str):
    """As ``parse``, which is asked once for short formulas that come again. Trees are read only."""
    return _kept_tree(text) if len(text) <= LONGEST_KEPT else parse(text)


@functools.lru_cache(MOST_TREES)
def _kept_tree(text: str):
    return parse(text)


def parse(text: str):
    """The tree of a formula without its equals sign, as nested tuples; Syntax if it is none."""
    stream, at = tokens(text), 0

    def take(op: str | None = None):
        nonlocal at
        token = stream[at]
        if op is not None and token != ("op", op):
            raise Syntax(op)
        at += 1
        return token

    def primary():
        kind, word = take()
        if kind == "num":
            return "lit", float(word)
        if kind == "str":
            return "lit", word
        if kind == "id":
            if stream[at] == ("op", "("):
                take()
                args = []
                if stream[at] != ("op", ")"):
                    args.append(expression(0))
                    while stream[at] == ("op", ","):
                        take()
                        args.append(expression(0))
                take(")")
                return "call", word.upper(), args
            if word.upper() in ("TRUE", "FALSE"):
                return "lit", word.upper() == "TRUE"
            first = address(word)
            if first is None:
                raise Syntax(word)
            if stream[at] == ("op", ":"):
                take()
                last = address(take()[1])
                if last is None:
                    raise Syntax(word)
                return "range", *(min(first[0], last[0]), min(first[1], last[1]), max(first[0], last[0]), max(first[1], last[1]))
            return "cell", first
        if (kind, word) == ("op", "("):
            inner = expression(0)
            take(")")
            return inner
        if kind == "op" and word in "+-":
            inner = expression(SIGN)
            return inner if word == "+" else ("sign", inner)
        raise Syntax(word)

    def expression(least: int):
        left, bound = primary(), 99
        while stream[at][0] == "op" and least < (power := POWERS.get(stream[at][1], -1)):
            op = stream[at][1]
            if power > bound:  # nothing binds to what a weaker postfix has closed
                raise Syntax(op)
            take()
            if op == "%":
                left, bound = ("percent", left), power
            else:
                left = ("binary", op, left, expression(SIGN - 1 if op == "^" else power))
        return left

    tree = expression(0)
    if stream[at][0] != "end":
        raise Syntax(stream[at][1])
    return tree


#: Results that a worker keeps of formulas that name a few cells, none of which is a formula: sheets that are alike repeat these too.
MOST_RESULTS, MOST_NAMED, LONGEST_GIVEN = 16_384, 4, 64


@functools.lru_cache(MOST_TREES)
def _named_cells(text: str) -> tuple[tuple[int, int], ...] | None:
    """The cells that a formula names; null if they are many, or ranges, or it cannot be read."""
    try:
        tree(text[1:])
    except (Syntax, IndexError, RecursionError):
        return None
    named = dict.fromkeys(references(text))
    return tuple(x[:2] for x in named) if len(named) <= MOST_NAMED and all(x[:2] == x[2:] for x in named) else None


def _is_short_literal(text: str | None) -> bool:
    return text is None or len(text) <= LONGEST_GIVEN and (text[:1] != "=" or len(text) == 1)


@functools.lru_cache(MOST_RESULTS)
def _result(text: str, given: tuple[str | None, ...]):
    """The value of a formula by the inputs of the cells that it names, in their order. Functions depend on nothing else."""
    return Sheet({at: x for at, x in zip(_named_cells(text), given) if x is not None}).worked_out(ALONE, text)


CODES = re.compile(r"(?i)\b(INR|USD|EUR|GBP|Rs\.?)\s*")
MARKS = re.compile(r"[₹$€£,\s]")


def read_number(text: str) -> float | None:
    if text.isascii() and text.isdigit():
        return float(text)
    t = text.strip()
    negative = len(t) > 1 and t[0] == "(" and t[-1] == ")"
    bare = MARKS.sub("", CODES.sub("", t[1:-1] if negative else t))
    try:
        x = float(bare) if bare and "_" not in bare else None
    except ValueError:
        x = None
    return None if x is None else -abs(x) if negative else x


def literal(text: str):
    if not text.strip():
        return None
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    return text if (x := read_number(text)) is None else x


def number(v):
    if isinstance(v, Err):
        return v
    if v is None:
        return 0.0
    if isinstance(v, str):
        return VALUE if (x := read_number(v)) is None else x
    return float(v)


def shown(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return str(v)
    if math.isnan(v):
        return VALUE
    if math.isinf(v):
        return DIV
    if abs(v) < 1e15 and v == math.floor(v):
        return str(int(v))
    return f"{v:.10f}".rstrip("0").rstrip(".")


def truth(v):
    if isinstance(v, Err):
        return v
    if isinstance(v, str):
        return {"TRUE": True, "FALSE": False}.get(v.strip().upper(), VALUE)
    return bool(v)


class Sheet:
    """Evaluates the cells of one sheet: inputs by (row, column)."""

    def __init__(self, inputs: dict[tuple[int, int], str]):
        if len(inputs) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells in a sheet")
        self.inputs, self.done, self.open = inputs, {}, set()

    def value(self, at: tuple[int, int]):
        text = self.inputs.get(at)
        if text is None:
            return None
        if not text.startswith("=") or len(text) == 1:
            return literal(text[1:] if text.startswith("'") else text)
        if at in self.done:
            return self.done[at]
        if at in self.open:
            self.done[at] = CIRCULAR
            return CIRCULAR
        if len(text) <= LONGEST_KEPT and (named := _named_cells(text)) is not None:
            given = tuple([self.inputs.get(x) for x in named])
            if all(_is_short_literal(x) for x in given):
                self.done[at] = result = _result(text, given)
                return result
        return self.worked_out(at, text)

    def worked_out(self, at: tuple[int, int], text: str):
        self.open.add(at)
        try:
            result = self.run(tree(text[1:]))
        except Syntax:
            result = NAME
        except (ArithmeticError, ValueError, RecursionError, IndexError):
            result = VALUE
        finally:
            self.open.discard(at)
        self.done[at] = result
        return result

    def cells(self, node) -> list:
        _, r0, c0, r1, c1 = node
        if (r1 - r0 + 1) * (c1 - c0 + 1) > MOST_RANGE:
            raise ValueError("range")
        return [self.value((r, c)) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]

    def run(self, node):
        kind = node[0]
        if kind == "lit":
            return node[1]
        if kind == "cell":
            return self.value(node[1])
        if kind == "range":
            return VALUE
        if kind in ("sign", "percent"):
            x = number(self.run(node[1]))
            return x if isinstance(x, Err) else -x if kind == "sign" else x / 100
        if kind == "call":
            return self.call(node[1], node[2])
        _, op, left, right = node
        a = self.run(left)
        if isinstance(a, Err):
            return a
        b = self.run(right)
        if isinstance(b, Err):
            return b
        if op == "&":
            return shown(a) + shown(b)
        if POWERS[op] == 10:
            if not (isinstance(a, float) and isinstance(b, float)):
                a, b = shown(a).lower(), shown(b).lower()
            return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        a, b = number(a), number(b)
        for x in (a, b):
            if isinstance(x, Err):
                return x
        if op == "/":
            return DIV if b == 0 else a / b
        if op == "^":
            return power(a, b)
        return a + b if op == "+" else a - b if op == "-" else a * b

    def call(self, name: str, args: list):
        if name in LAZY:
            return LAZY[name](self, args)
        flat = [v for a in args for v in (self.cells(a) if a[0] == "range" else [self.run(a)])]
        if name in TOLERANT:
            return TOLERANT[name](flat)
        if name not in FUNCTIONS:
            return NAME
        return next((v for v in flat if isinstance(v, Err)), None) or FUNCTIONS[name](flat)


def power(a: float, b: float):
    try:
        x = math.pow(a, b)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan
    return x


def _if(sheet: Sheet, args):
    if not 2 <= len(args) <= 3:
        return VALUE
    test = truth(sheet.run(args[0]))
    if isinstance(test, Err):
        return test
    return sheet.run(args[1]) if test else sheet.run(args[2]) if len(args) == 3 else False


def _instead(which: Callable[[object], bool]):
    def run(sheet: Sheet, args):
        if len(args) != 2:
            return VALUE
        v = sheet.run(args[0])
        return sheet.run(args[1]) if which(v) else v

    return run


def _all_or_any(stop: bool):
    def run(sheet: Sheet, args):
        if not args:
            return VALUE
        for a in args:
            for v in sheet.cells(a) if a[0] == "range" else [sheet.run(a)]:
                if v is None:
                    continue
                t = truth(v)
                if isinstance(t, Err):
                    return t
                if t is stop:
                    return stop
        return not stop

    return run


def criterion(c) -> Callable[[object], bool]:
    """Whether a value meets a criterion such as ">=3", "<>a*" or 7."""
    m = re.match(r"(>=|<=|<>|>|<|=)?(.*)\Z", shown(c), re.S)
    op, operand = (m[1] or "=", m[2]) if not isinstance(c, float) else ("=", shown(c))
    try:
        n = float(operand)
    except ValueError:
        pattern = re.compile("".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in operand) + r"\Z", re.I)
        like = lambda v: not isinstance(v, float) and pattern.match(shown(v)) is not None
        return {"=": like, "<>": lambda v: not like(v)}.get(op, lambda v: False)
    test = {"=": n.__eq__, "<>": n.__ne__, ">": n.__lt__, "<": n.__gt__, ">=": n.__le__, "<=": n.__ge__}[op]
    return lambda v: test(v) if isinstance(v, float) else op == "<>"


def _conditional(name: str):
    def run(sheet: Sheet, args):
        if len(args) not in ((2,) if name == "COUNTIF" else (2, 3)) or any(a[0] != "range" for a in (args[0], *args[2:])):
            return VALUE
        c = sheet.run(args[1])
        if isinstance(c, Err):
            return c
        tested, meets = sheet.cells(args[0]), criterion(c)
        values = sheet.cells(args[2]) if len(args) == 3 else tested
        hits = [i for i, v in enumerate(tested) if meets(v)]
        if name == "COUNTIF":
            return float(len(hits))
        numbers = [values[i] for i in hits if i < len(values) and isinstance(values[i], float)]
        return float(sum(numbers)) if name == "SUMIF" else sum(numbers) / len(numbers) if numbers else DIV

    return run


LAZY = {
    "IF": _if, "IFERROR": _instead(lambda v: isinstance(v, Err)), "IFNA": _instead(lambda v: isinstance(v, Err) and v == NA), "AND": _all_or_any(False), "OR": _all_or_any(True),
    **{n: _conditional(n) for n in ("COUNTIF", "SUMIF", "AVERAGEIF")},
}
_one = lambda a: a[0] if a else None
TOLERANT = {
    "COUNT": lambda a: float(sum(isinstance(v, float) for v in a)), "COUNTA": lambda a: float(sum(v is not None for v in a)), "COUNTBLANK": lambda a: float(sum(v is None or v == "" for v in a)),
    "ISERROR": lambda a: isinstance(_one(a), Err), "ISNUMBER": lambda a: isinstance(_one(a), float), "ISTEXT": lambda a: isinstance(_one(a), str) and not isinstance(_one(a), Err), "ISBLANK": lambda a: _one(a) is None, "PI": lambda a: math.pi,
}


def numbers(args) -> list[float]:
    return [v for v in args if isinstance(v, float)]


def math_of(n: int, f: Callable, *defaults: float):
    """A function of ``n`` numbers, the last of which may be left out if there are defaults for them."""

    def run(args):
        given = list(args[:n]) + list(defaults[len(defaults) - (n - len(args)) :] if len(args) < n else ())
        if len(given) < n:
            return VALUE
        given = [number(v) for v in given]
        return next((v for v in given if isinstance(v, Err)), None) or f(*given)

    return run


def of_numbers(f: Callable, least: int = 1, short=DIV):
    return lambda args: f(x) if len(x := numbers(args)) >= least else short


def ranked(last_first: bool):
    def run(args):
        *x, k = numbers(args) or [0.0]
        x.sort(reverse=last_first)
        return x[int(k) - 1] if 1 <= int(k) <= len(x) else NUM

    return run


def percentile(args):
    *x, p = numbers(args) or [0.0]
    if not x or not 0 <= p <= 1:
        return NUM
    x.sort()
    at = p * (len(x) - 1)
    low = math.floor(at)
    return x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def mode(args):
    counts = Counter(numbers(args))
    best = max(counts.values(), default=0)
    return next(x for x, n in counts.items() if n == best) if best > 1 else NA


def half_up(x: float, digits: float) -> float:
    scale = 10.0 ** int(digits)
    return math.floor(x * scale + 0.5) / scale


def toward(up: bool):
    def run(x, digits):
        scale = 10.0 ** int(digits)
        y = math.ceil(abs(x) * scale - 1e-9) if up else math.floor(abs(x) * scale + 1e-9)
        return math.copysign(y / scale, x) if y else 0.0

    return run


def multiple(how):
    return math_of(2, lambda x, s: 0.0 if s == 0 else float(how(x / s)) * s, 1.0)


def text_of(args, i: int = 0, default: str = "") -> str:
    return shown(args[i]) if i < len(args) else default


def text_format(args):
    form, x = text_of(args, 1), number(_one(args))
    if not args or not form or isinstance(x, Err) or set(form) - set("0#,.%"):
        return text_of(args)
    percent = form.endswith("%")
    decimals = sum(c in "0#" for c in form.partition(".")[2])
    scale = 10.0**decimals
    x = x * 100 if percent else x
    return f"{math.copysign(math.floor(abs(x) * scale + 0.5) / scale, x):{',' if ',' in form else ''}.{decimals}f}" + "%" * percent


def piece(args, right: bool):
    n = number(args[1]) if len(args) > 1 else 1.0
    if isinstance(n, Err):
        return n
    n, t = max(0, int(n)), text_of(args)
    return (t[-n:] if n else "") if right else t[:n]


def mid(args):
    start, n = (number(args[i]) if i < len(args) else VALUE for i in (1, 2))
    if isinstance(start, Err) or isinstance(n, Err) or start < 1 or n < 0:
        return VALUE
    return text_of(args)[int(start) - 1 : int(start) - 1 + int(n)]


def find(fold: bool):
    def run(args):
        needle, hay = text_of(args), text_of(args, 1)
        start = number(args[2]) if len(args) > 2 else 1.0
        if isinstance(start, Err) or start < 1:
            return VALUE
        at = hay.lower().find(needle.lower(), int(start) - 1) if fold else hay.find(needle, int(start) - 1)
        return VALUE if at < 0 else float(at + 1)

    return run


def substitute(args):
    t, old, new = (text_of(args, i) for i in range(3))
    if not old:
        return t
    if len(args) < 4:
        return t.replace(old, new)
    n = number(args[3])
    if isinstance(n, Err) or n < 1:
        return VALUE
    parts = t.split(old)
    k = int(n)
    return old.join(parts[:k]) + new + old.join(parts[k:]) if k < len(parts) else t


def splice(args):
    start, n = (number(args[i]) if i < len(args) else VALUE for i in (1, 2))
    if isinstance(start, Err) or isinstance(n, Err) or start < 1 or n < 0:
        return VALUE
    t, at = text_of(args), int(start) - 1
    return t[:at] + text_of(args, 3) + t[at + int(n) :]


def proper(args):
    out, before = [], ""
    for c in text_of(args):
        out.append(c.lower() if before.isalpha() else c.upper())
        before = c
    return "".join(out)


def joined(args):
    skip = truth(args[1]) if len(args) > 1 and args[1] is not None else True
    if isinstance(skip, Err):
        return skip
    return text_of(args).join(x for v in args[2:] if (x := shown(v)) or not skip)


def whole(f: Callable):
    return lambda args: float(functools.reduce(f, [abs(int(x)) for x in numbers(args)])) if numbers(args) else 0.0


def positive(f: Callable):
    return math_of(1, lambda x: NUM if x <= 0 else f(x))


def log(x, base):
    return NUM if x <= 0 or base <= 0 or base == 1 else math.log(x) / math.log(base)


def guarded(f: Callable):
    """Arguments outside a function's domain give a value that shows as an error, as arithmetic on doubles does."""

    def run(x):
        try:
            return f(x)
        except ValueError:
            return math.nan
        except OverflowError:
            return math.inf

    return math_of(1, run)


def character(x):
    return chr(int(x)) if 1 <= int(x) <= 65535 else VALUE


FUNCTIONS: dict[str, Callable] = {
    "SUM": of_numbers(lambda x: float(sum(x)), 0), "AVERAGE": of_numbers(lambda x: sum(x) / len(x)), "MIN": of_numbers(min, 1, 0.0), "MAX": of_numbers(max, 1, 0.0), "PRODUCT": of_numbers(lambda x: float(math.prod(x)), 1, 0.0),
    "SUMSQ": of_numbers(lambda x: float(sum(v * v for v in x)), 0), "MEDIAN": of_numbers(statistics.median, 1, NUM), "MODE": mode,
    "VAR": of_numbers(statistics.variance, 2), "VARP": of_numbers(statistics.pvariance), "STDEV": of_numbers(statistics.stdev, 2), "STDEVP": of_numbers(statistics.pstdev),
    "LARGE": ranked(True), "SMALL": ranked(False), "PERCENTILE": percentile,
    "ROUND": math_of(2, half_up, 0.0), "ROUNDUP": math_of(2, toward(True), 0.0), "ROUNDDOWN": math_of(2, toward(False), 0.0), "TRUNC": math_of(2, toward(False), 0.0),
    "CEILING": multiple(math.ceil), "FLOOR": multiple(math.floor), "MROUND": multiple(lambda q: math.floor(q + 0.5)),
    "ABS": math_of(1, abs), "INT": math_of(1, lambda x: float(math.floor(x))), "SQRT": math_of(1, lambda x: NUM if x < 0 else math.sqrt(x)), "POWER": math_of(2, power),
    "MOD": math_of(2, lambda a, b: DIV if b == 0 else a - b * math.floor(a / b)), "QUOTIENT": math_of(2, lambda a, b: DIV if b == 0 else float(math.trunc(a / b))),
    "SIGN": math_of(1, lambda x: float((x > 0) - (x < 0))), "EXP": guarded(math.exp), "LN": positive(math.log), "LOG10": positive(math.log10), "LOG": math_of(2, log, 10.0),
    **{n.upper(): guarded(getattr(math, n)) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "degrees", "radians")}, "ATAN2": math_of(2, lambda x, y: math.atan2(y, x)),
    "FACT": math_of(1, lambda x: float(math.factorial(int(x))) if 0 <= x <= 170 else NUM), "GCD": whole(math.gcd), "LCM": whole(math.lcm),
    "ISEVEN": math_of(1, lambda x: math.floor(abs(x)) % 2 == 0), "ISODD": math_of(1, lambda x: math.floor(abs(x)) % 2 == 1),
    "NOT": lambda a: t if isinstance(t := truth(_one(a)), Err) else not t,
    "XOR": lambda a: next((t for v in a if isinstance(t := truth(v), Err)), None) or sum(truth(v) for v in a) % 2 == 1,
    "LEN": lambda a: float(len(text_of(a))), "UPPER": lambda a: text_of(a).upper(), "LOWER": lambda a: text_of(a).lower(), "TRIM": lambda a: re.sub(" +", " ", text_of(a).strip()), "PROPER": proper,
    "CONCATENATE": lambda a: "".join(map(shown, a)), "CONCAT": lambda a: "".join(map(shown, a)), "TEXT": text_format, "TEXTJOIN": joined,
    "LEFT": lambda a: piece(a, False), "RIGHT": lambda a: piece(a, True), "MID": mid, "FIND": find(False), "SEARCH": find(True), "SUBSTITUTE": substitute, "REPLACE": splice,
    "REPT": lambda a: n if isinstance(n := number(a[1]) if len(a) > 1 else VALUE, Err) else VALUE if not 0 <= n <= 10_000 else text_of(a) * int(n),
    "EXACT": lambda a: text_of(a) == text_of(a, 1), "VALUE": lambda a: number(_one(a)), "CLEAN": lambda a: "".join(c for c in text_of(a) if ord(c) >= 32),
    "CHAR": math_of(1, character), "CODE": lambda a: float(ord(t[0])) if (t := text_of(a)) else VALUE, "TRUE": lambda a: True, "FALSE": lambda a: False,
}


def evaluate(formula: str, inputs: dict[tuple[int, int], str] | None = None):
    """The value of one formula, with or without its equals sign."""
    return Sheet({**(inputs or {}), ALONE: "=" + formula.removeprefix("=")}).value(ALONE)


def references(formula: str) -> list[tuple[int, int, int, int]]:
    """The cells and ranges (top, left, bottom, right) that a formula names; none of one that cannot be read."""
    try:
        left = [tree(formula.removeprefix("="))]
    except (Syntax, IndexError, RecursionError):
        return []
    out = []
    while left:
        node = left.pop()
        if node[0] == "cell":
            out.append((*node[1], *node[1]))
        elif node[0] == "range":
            out.append(node[1:])
        else:
            left += [x for part in node[1:] for x in (part if isinstance(part, list) else [part]) if isinstance(x, tuple)]
    return out


def dependents(inputs: dict[tuple[int, int], str], edited: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """The formula cells that name an edited cell, or one that does, and so on."""
    by_column: dict[int, list[tuple[int, int, tuple[int, int]]]] = {}
    for at, text in inputs.items():
        if text.startswith("=") and len(text) > 1:
            for r0, c0, r1, c1 in references(text):
                for c in range(c0, c1 + 1):
                    by_column.setdefault(c, []).append((r0, r1, at))
    # Columns where formulas name single rows only are looked up by row.
    single = {c: {} for c, named in by_column.items() if all(r0 == r1 for r0, r1, _ in named)}
    for c, rows in single.items():
        for r, _, at in by_column[c]:
            rows.setdefault(r, []).append(at)
    found, frontier = set(), list(edited)
    while frontier:
        r, c = frontier.pop()
        named = single[c].get(r, ()) if c in single else [at for r0, r1, at in by_column.get(c, ()) if r0 <= r <= r1]
        new = set(named) - found - edited
        found |= new
        frontier += new
    return found


def _by_sheet(cells: DataFrame, fields: list[str], work: Callable, schema: str) -> DataFrame:
    """``work`` (name, rows of ``fields``) to rows of ``schema`` for every sheet.

    Sheets are dealt by name and read one after the other from sorted partitions, so that many small sheets share a batch
    and a worker holds one sheet at a time.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    made = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), made.types)] if out else [pa.array([], k) for k in made.types], schema=made)

    def run(batches):
        name, rows, out = None, [], []
        for batch in batches:
            for s, *row in zip(*(batch.column(k).to_pylist() for k in ("sheet", *fields))):
                if s != name and rows:
                    out += work(name, rows)
                    rows = []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                name = s
                rows.append(row)
        out += work(name, rows)
        yield batch_of(out)

    return cells.select("sheet", *fields).repartition("sheet").sortWithinPartitions("sheet").mapInArrow(run, schema)


def _display(sheet: Sheet, at: tuple[int, int], text: str) -> str:
    return shown(sheet.value(at)) if text.startswith("=") and len(text) > 1 else text.removeprefix("'")


SHEET = (("sheet", "string"), ("row", "int"), ("col", "int"), ("input", "string"))


def _typed(cells: DataFrame, **more: str):
    """The columns of a sheet with their types; null names are one sheet, null inputs empty."""
    text = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit("")).alias(c) if t == "string" else F.col(c).cast(t).alias(c)
    return cells.select(*[text(c, t) for c, t in (*SHEET, *more.items())])


def recalculate(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, input) to (sheet, row, col, input, display) with every formula worked out; null names are one sheet."""

    def work(name, rows):
        sheet = Sheet({(int(r), int(c)): t for r, c, t in rows})
        return [(name, r, c, t, _display(sheet, (r, c), t)) for r, c, t in rows]

    return _by_sheet(_typed(cells), ["row", "col", "input"], work, "sheet string, row int, col int, input string, display string")


def edited(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """(sheet, row, col, input, display, changed) after ``edits`` (sheet, row, col, input) to ``cells``, which were worked out before.

    Only edited cells and their dependents are worked out again (``changed``); all others keep their display. Of several
    edits of a cell the last by its text counts. An edit may be of a cell that was empty.
    """
    new = _typed(edits).groupBy("sheet", "row", "col").agg(F.max("input").alias("new"))
    both = _typed(cells, display="string").join(new, ["sheet", "row", "col"], "full")
    both = both.select("sheet", "row", "col", F.coalesce("new", "input", F.lit("")).alias("input"), F.coalesce("display", F.lit("")).alias("display"), F.col("new").isNotNull().alias("changed"))

    def work(name, rows):
        inputs = {(int(r), int(c)): t for r, c, t, _, _ in rows}
        sheet, own = Sheet(inputs), {(int(r), int(c)) for r, c, _, _, new in rows if new}
        again = own | dependents(inputs, own) if own else own
        return [(name, r, c, t, _display(sheet, (r, c), t) if (r, c) in again else shown_before, (r, c) in again) for r, c, t, shown_before, _ in rows]

    return _by_sheet(both, ["row", "col", "input", "display", "changed"], work, "sheet string, row int, col int, input string, display string, changed boolean")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, cells): the used range of each sheet as rows of displayed texts, gaps as empty ones."""
    # A number of partitions that is given stays: those that are put together after a shuffle grow with the table.
    dealt = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sheet")
    used = F.when(F.trim("input") != "", F.col("col"))
    filled = dealt.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "display"))).alias("by"), F.min(used).alias("left"), F.max(used).alias("right"))  # a row of a sheet
    ordered = Window.partitionBy("sheet").orderBy("row")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has_text = F.when(F.col("left").isNotNull(), F.col("row"))
    ranged = filled.select("sheet", "row", "by", *[f(c).over(whole).alias(n) for n, f, c in (("top", F.min, has_text), ("bottom", F.max, has_text), ("left", F.min, "left"), ("right", F.max, "right"))])
    # A row without cells follows the last one before it that has some.
    ranged = ranged.where("row between top and bottom").withColumn("last", F.coalesce(F.lead("row").over(ordered) - 1, "row"))
    rows = ranged.select("sheet", F.col("row").alias("own"), "by", "left", "right", F.explode(F.sequence("row", "last")).alias("row"))
    by = F.when(F.col("row") == F.col("own"), F.col("by"))
    return rows.select("sheet", "row", F.transform(F.sequence("left", "right"), lambda c: F.coalesce(F.try_element_at(by, c), F.lit(""))).alias("cells"))


def used_range(cells: DataFrame) -> DataFrame:
    some = cells.where("trim(input) <> ''")
    return some.groupBy("sheet").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))


def rows_to_cells(df: DataFrame, sheet: str, rid: str) -> DataFrame:
    """A table as a sheet: its header in row 0; a leading equals sign is marked as text."""
    names = [c for c in df.columns if c != rid]
    text = lambda c: F.when(c.startswith("="), F.concat(F.lit("'"), c)).otherwise(c)
    body = df.select(F.col(rid).cast("int").alias("row"), F.posexplode(F.array(*[text(F.col(f"`{c}`").cast("string")) for c in names])).alias("col", "input"))
    head = df.sparkSession.createDataFrame([(0, i, c) for i, c in enumerate(names)], "row int, col int, input string")
    return head.unionAll(body).select(F.lit(sheet).alias("sheet"), "row", "col", "input")
