"""Patterns that may run away are refused before they run, all others are taken."""

import itertools
import re

import pytest

from gridloom.functions import cells, patterns

BAD = [r"(a+)+$", r"(a*)*b", r"([a-zA-Z]+)*!", r"(a|aa)+$", r"(a|a?)+$", r"(.*a){20}$", r"(x+x+)+y", r"^(([a-z])+.)+[A-Z]([a-z])+$", r"(\d+\s*)*x", r"(a|b|ab)*c", r"(?:\w+\.?)+@", r"((ab)*)*", r"(?i)(a|A)+b", r"(a?b?)*c", r"\p{L}+(\w+)*!", r"(?=(a+)+b)a"]
GOOD = [r"a+b+", r"[^,]*,", r"\s+$", r"(\d{3})-(\d{4})", r"(ab|cd)*e", r"(a|b)+c", r"^\s*([a-z]+)\s*=\s*(.*)$", r"(?:\w+\.)+@", r"\b\w+\b", r"(foo|bar|baz){2,5}", r"[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?", r"\Qa+b*\E+", r"(?<=x)y?", "", "x", r"\p{Lu}+", r"colou?r", r"(a*b)*c", r"(ab*)+c", r"(\d+,)*\d+"]


@pytest.mark.parametrize("pattern", BAD)
def test_refused(pattern):
    with pytest.raises(patterns.Unsafe):
        patterns.checked(pattern)


@pytest.mark.parametrize("pattern", GOOD)
def test_taken(pattern):
    assert patterns.checked(pattern) == pattern


def test_what_cannot_be_told_is_refused():
    for pattern in (r"(a)\1", "(", "a" * 500):
        with pytest.raises(patterns.Unsafe):
            patterns.checked(pattern)


def test_against_counted_ways_of_reading():
    """Small loops over two letters: refused if and only if some word has more and more ways to be read by one loop."""
    atoms = ["a", "b", "a?", "ab", "a*", "[ab]", "(?:a|b)", "(?:a|ab)"]

    def ways(parts, text):
        """Ways in which text is parted into readings of the loop's body: by all parts of it, each in each way."""
        options = {"a": [{"a": 1}], "b": [{"b": 1}], "a?": [{"a": 1, "": 1}], "ab": [{"ab": 1}], "a*": [{"a" * n: 1 for n in range(8)}], "[ab]": [{"a": 1, "b": 1}], "(?:a|b)": [{"a": 1, "b": 1}], "(?:a|ab)": [{"a": 1, "ab": 1}]}
        bodies: dict[str, int] = {}
        for chosen in itertools.product(*(options[p][0] for p in parts)):
            bodies["".join(chosen)] = bodies.get("".join(chosen), 0) + 1
        counts = [1] + [0] * len(text)
        for end in range(1, len(text) + 1):
            counts[end] = sum(counts[start] * bodies.get(text[start:end], 0) for start in range(end))
        return counts[-1]

    words = ["".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)]
    for parts in [*itertools.product(atoms, repeat=1), *itertools.product(atoms, repeat=2)]:
        most = max(ways(parts, w) for w in words)
        assert patterns.runs_away(f"(?:{''.join(parts)})*c") == (most > 1), (parts, most)


def test_rules_refuse_before_the_plan(spark):
    with pytest.raises(patterns.Unsafe):
        cells.replace_all("x", "(a+)+$", "", regex=True)
    frame = spark.createDataFrame([("a+a+",)], "x string")
    assert frame.select(cells.replace_all("x", "(a+)+$", "-").alias("y"), cells.replace_all("x", "a[+]", "$0!", regex=True).alias("z")).first() == ("a+a+", "a+!a+!")
    assert re.compile("x")
