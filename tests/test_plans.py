import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.functions import ngrams
from siftline.plans import planner, regex


def grams(text: str) -> set[str]:
    b = text.encode()
    return {b[i:j].decode() for i, j in ngrams.spans(b, None)}


def cover(text: str) -> set[str]:
    return {g.decode() for g in ngrams.covering(text.encode())}


# Grams and covering grams of known texts.
def test_grams_of_known_texts():
    assert grams("he") == set()
    assert grams("hel") == {"hel"}
    assert grams("hell") == {"hel", "ell"}
    assert grams("hello world") == {"hel", "ell", "llo", "lo ", "o w", "lo w", " wo", "lo wo", "wor", "orl", "worl", "rld"}
    assert grams("chester ") == {"che", "hes", "ches", "est", "chest", "ste", "ter", "ster", "er "}


def test_covering_of_known_literals():
    assert cover("he") == set()
    assert cover("hell") == {"hel", "ell"}
    assert cover("hello world") == {"hel", "ell", "llo", "rld", "worl", "lo wo"}
    assert cover("chester ") == {"chest", "ster", "er "}
    assert cover("chester") == {"chest", "ster"}
    assert cover("for(int i=42") == {"for(i", "(int i=4", "=42"}


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=120), st.integers(0, 100), st.integers(3, 40))
def test_a_literal_is_covered_by_grams_of_every_text_that_holds_it(text, at, n):
    literal = text[at : at + n]
    held = {text[i:j] for i, j in ngrams.spans(text)}
    found = ngrams.covering(literal)
    assert set(found) <= held and all(3 <= len(g) <= 16 for g in found)
    assert len(found) <= max(0, len(literal) - 2)
    hashes = set(ngrams.gram_hashes(text).tolist())
    assert hashes == {ngrams.gram_hash(g) for g in held}


ACCEPTED = [
    "abc", "a|b", "a*", "(ab)+?", "(?i)k", "[a-z&&[^aeiou]]", r"[a-z--[aeiou]]x", "(?P<n>a)", "(?<n>a)", r"\d+", r"\x41\x{263a}", "a{2,3}", "(?x) a b # c",
    "a++", "(?m)^x$", "(?s).", "[[:alpha:]_]+", r"[]a]", r"[a\]-]", r"\pL", r"\p{Greek}", "a{0}", "", "(?i:ab)c", "(?U)a+", "x{ 2 }" ,
]
REJECTED = ["(", ")", "a{", "{2}", "*a", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"(a)\1", "(?>a)", "[", "[z-a]", "a{3,2}", r"\q", "(?-u:a)", "[[:nope:]]", "a{9999}", "(?i", "\\"]


@pytest.mark.parametrize("pattern", ACCEPTED)
def test_accepted(spark, pattern):
    java = regex.java(regex.parse(pattern))
    spark._jvm.java.util.regex.Pattern.compile(java)


@pytest.mark.parametrize("pattern", REJECTED)
def test_rejected(pattern):
    with pytest.raises(regex.InvalidPattern):
        regex.parse(pattern)


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        ("c.", "c\r", True), ("end$", "end\n", False), ("(?m)a$", "a\nb", True), (r"\d", "٣", True), (r"\w", "é", True), ("(?i)k", "K", True),
        ("(?i)s", "ſ", True), ("^a++a", "aaa", True), ("(?i)é", "É", True), ("[a-z&&[^b]]", "b", False), ("[a-z--b]", "c", True), ("[ab~~bc]", "b", False),
        ("(?U)^a+$", "aaa", True), ("(?x)a b", "ab", True), ("(?-i)A", "a", False), ("(?i)a(?-i)B", "Ab", False), (".", "\n", False), ("(?s)^.$", "\n", True),
        (r"\bfoo\b", "a foo b", True), ("[^a]", "\n", True),
    ],
)
def test_dialect(spark, pattern, text, found):
    p = spark._jvm.java.util.regex.Pattern.compile(regex.java(regex.parse(pattern)))
    assert p.matcher(text).find() == found


def test_literals():
    plan = planner.decompose("hello world")
    assert [b.literal for b in plan.prefix] == [b.literal for b in plan.suffix] == [b"hello world"]
    assert {b.literal for b in planner.decompose("cat|dog").prefix} == {b"cat", b"dog"}
    for unconstrained in (".*", "42", "[a-z]+", r"\d+", "ab|hello", "(hello)?", "x*", "(?i)kit", "^$"):
        assert planner.decompose(unconstrained).unconstrained, unconstrained
    assert [b.literal for b in planner.decompose("HeLLo").prefix] == [b"hello"]
    assert {b.literal for b in planner.decompose("the.*tion").suffix} == {b"tion"}
    assert {b.literal for b in planner.decompose("tabs?").prefix} == {b"tab", b"tabs"}
    assert planner.decompose("hello").gram_count() > 0


def random_pattern(r: random.Random, depth: int = 0) -> str:
    kind = r.randrange(7 if depth < 2 else 3)
    if kind <= 1:
        return "".join(r.choice("abcdAB") for _ in range(r.randrange(1, 6)))
    if kind == 2:
        return r.choice(["[ab]", "[a-d]", ".", "[^a]", "(?:)"])
    if kind == 3:
        return f"(?:{random_pattern(r, depth + 1)}|{random_pattern(r, depth + 1)})"
    if kind == 4:
        return f"(?:{random_pattern(r, depth + 1)}){r.choice(['*', '+', '?', '{2}', '{1,3}', '{2,}'])}"
    return random_pattern(r, depth + 1) + random_pattern(r, depth + 1)


def test_every_match_begins_and_ends_with_a_literal():
    r = random.Random(7)
    tried = 0
    for _ in range(1500):
        pattern = random_pattern(r)
        tree = regex.parse(pattern)
        text = "".join(r.choice("abcdAB") for _ in range(12))
        for m in re.finditer(pattern, text):
            for front in (True, False):
                seq = regex.literals(tree, front)
                if seq is not None:
                    b = m[0].encode()
                    assert any(b.startswith(s) if front else b.endswith(s) for s, _ in seq), (pattern, m[0], seq)
                    tried += 1
    assert tried > 1000
