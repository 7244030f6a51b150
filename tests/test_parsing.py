"""The scanning parser: brackets in strings and comments, heads and imports of several lines."""

import random

import pytest

from graincode.operators.parsing import brackets, code_only, parse_patterns
from graincode.plans.queries_scan import SOURCES

LANGUAGES = [k for k in SOURCES if k != "python"]
#: What may stand in a line of its own anywhere between statements, in each language.
NOISE = {
    "go": ["// }{ func x() {", "/* { */", "/* \n func dead() {\n */"],
    "java": ["// }{ class X {", "/* { */", "/* \n class Dead {\n */"],
    "javascript": ["// }{ class X {", "/* ` { */", "/* \n class Dead {\n */"],
    "typescript": ["// }{ class X {", "/* ` { */", "/* \n interface Dead {\n */"],
    "php": ["// }{ class X {", "# }", "/* { */", "/* \n class Dead {\n */"],
    "rust": ["// }{ fn x() {", "/* { /* } */ { */", "/* \n struct Dead {\n */"],
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_comments_change_only_lines(language):
    """Comments with brackets after any line that is no text or template: the same symbols, imports and calls, moved."""
    rng, source = random.Random(2), SOURCES[language].replace("%d", "1")
    code, _ = code_only(source, language)
    lines, bare = source.split("\n"), code.split("\n")
    free = [i for i, (a, b) in enumerate(zip(lines, bare)) if a == b and not (b.rstrip().endswith((",", "(", "=>")) and language == "go")]
    want = parse_patterns(source, language)
    shape = lambda p: ([(s[0], s[1], s[2]) for s in p[0]], [(i[0], i[1]) for i in p[1]], p[2], [c[:2] for c in p[3]])
    for _ in range(20):
        at = sorted(rng.sample(free, 3), reverse=True)
        made = list(lines)
        for i in at:
            made.insert(i + 1, rng.choice(NOISE[language]))
        got = parse_patterns("\n".join(made), language)
        assert shape(got) == shape(want)
        for s, t in zip(got[0], want[0]):
            assert s[5].split("\n")[0] == t[5].split("\n")[0] and s[5].split("\n")[-1] == t[5].split("\n")[-1]


def test_code_only_keeps_places():
    for language in LANGUAGES:
        source = SOURCES[language]
        code, bare = code_only(source, language)
        assert len(code) == len(bare) == len(source) and code.count("\n") == bare.count("\n") == source.count("\n")
        assert all(c in (" ", s) and b in (" ", s) for s, c, b in zip(source, code, bare))
        pairs = brackets(code)
        assert len(pairs) == sum(code.count(c) for c in "([{") == sum(code.count(c) for c in ")]}")


@pytest.mark.parametrize(
    ("language", "source", "code"),
    [
        ("javascript", "a = `x ${f(`y ${g} }`)} }` + b", "a = f( g ) + b"),
        ("javascript", "a = /[/}]\"/g; b / c / d", "a = ; b / c / d"),
        ("rust", "/* a /* b */ c */ d 'x' 'a T r##\"x\"# \"## e", "d 'a T e"),
        ("php", "f(<<<A\n}\n A . 1);", "f( . 1);"),
        ("go", "x := `a\"` + \"b\\\"`\" // c", "x := +"),
        ("java", 's = """\n"}" \\""" """; t', "s = ; t"),
        ("javascript", "open `text", "open"),
    ],
)
def test_code_only(language, source, code):
    assert " ".join(code_only(source, language)[0].split()) == code


def test_brackets_that_do_not_match():
    assert brackets("(a[b)c]{") == {0: 4} and brackets(")(") == {} and brackets("") == {}


def test_unfinished_sources_end():
    for language in LANGUAGES:
        source = SOURCES[language]
        for cut in range(0, len(source), 7):
            parse_patterns(source[:cut], language)


def test_long_sources_take_linear_time():
    import time

    def took(n):
        source = "".join(f"export function f{i}(a,\n b) {{\n  return g(`${{a}} }}`);\n}}\n" for i in range(n))
        began = time.process_time()
        assert len(parse_patterns(source, "javascript")[0]) == n
        return time.process_time() - began

    took(200)
    assert took(4000) < 12 * took(1000)
