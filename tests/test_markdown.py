"""The Markdown reader against cases worked out by hand from the published rules."""

import random
import re
import time

import pytest

from proselake.functions.markdown import headings_of, prose_of, table_ranges_of

HEADS = lambda text: [(h["level"], h["text"]) for h in headings_of(text)]


@pytest.mark.parametrize(("text", "want"), [
    # containers: markers, widths, lazy lines, tabs
    ("> a\nb\n\nc", "a b c "), ("> a\n\n> b", "a b "), ("> a\n---", "a "), ("> - a\nb", "a b"), ("- a\n > b\n", "ab "), ("- a\n\n b", "ab "), ("- a\n\n  b", "a b "), ("1. a\n\n   > b\n   > c\n\n2. d", "a b c d "),
    ("> > > a\nb", "a b "), (">>> a\n> b\n>>c", "a b c "), (">     code\n\n>    not", "not "), ("-\ta\n\n\tb", "a b "), ("- a\n\n\t\tcode\n", "a "), ("-\n\n  a", "a "), ("-\n  a", "a"), ("- a\n-\n- b", "ab"),
    ("10) a\n   b", "a b"), ("text\n2. b", "text 2. b "), ("text\n1. b", "text b"), ("text\n-", ""), ("text\n*", "text * "), ("text\n- b", "text b"), ("-a\n*b\n+c", "-a *b +c "), ("- a\n* b", "ab"), ("1. a\n1) b", "ab"),
    ("1234567890. a", "1234567890. a "), ("- a\n  - b\n    - c", "abc"), ("- a\n  - b\n\n    c\n- d", "ab c d"), ("* a\n  > b\n  >\n* c", "ab c"), ("- a\n  ```\n  x\n\n\n  ```\n- b", "ab"), ("- a\n\n\n- b", "a b "),
    ("- - - a", "a"), ("- a\n    lazy", "a lazy"), ("> ```\n> x\ny", "y "), ("- a\nb\n\nc", "a bc "), ("> a\n    b", "a b "), ("- a\n\n<!-- -->\n\n- b", "ab"), ("- a\n\n  [r]: /u\n- b", "a b "),
    # leaves: code, headings, rules, HTML
    ("    code\n\n    more\nend", "end "), ("a\n    b", "a b "), ("```\na\n~~~\nb\n```\nc", "c "), ("~~~ x `y`\na\n~~~~\nb", "b "), ("``` a`b\nc", "``` a`b c "), ("````\na\n```\nb\n`````\nc", "c "), ("```\nopen", ""),
    ("a\n```\nb\n```\nc", "a c "), ("   ```\n   a\n  ```\nb", "b "), ("# a\nb", "b "), ("#a", "#a "), ("\\# a", "# a "), ("a\n# b\nc", "a c "), ("a\n=\nb", "b "), ("a\n= =", "a = = "), ("***\n---\n_ _ _", ""),
    ("+++\n--\n**", "** "), ("a\n***\nb", "a b "), ("<table>\n<tr>\n\nx", "x "), ("<b>\nx\n</b>\n\ny", "y "), ("a\n<b>\nx", "a  x "), ("a\n<div>\nx", "a "), ("<pre>\n\nx\n</pre>\ny", "y "),
    ("<?x\n\ny?>z\nw", "w "), ("<![CDATA[\n\na\n]]>\nb", "b "), ("<!DOCTYPE html>\na", "a "), ("<a href='x'>\ny", ""), ("<a href='x'> z\ny", " z y "), ("    <div>\na", "a "),
    # links, definitions, images, footnotes
    ("[a](b)", "a "), ("[a](<b c> 'd')", "a "), ("[a](b c)", "[a](b c) "), ("[a](b(c)d)", "a "), ("[a](b(c)", "[a](b(c) "), ("[a](b\n'c\nd')", "a "), ("[a] (b)", "[a] (b) "), ("[a [b](c)](d)", "[a b](d) "),
    ("![a [b](c)](d)", "a b "), ("[![a](b)](c)", "a "), ("[a][R]\n\n[r]: <>", "a "), ("[a][]\n\n[A]: x", "a "), ("[a]\n\n[a]: x\n'open", "a 'open "), ("[a]: x \"t\" y", "[a]: x \"t\" y "), ("[a]:\nx\n[a]", "a "),
    ("b\n[a]: x\n\n[a]", "b [a]: x [a] "), ("[a][b]\n\n[a]: x", "[a][b] "), ("[a]: x\n===\n[a]", "=== a "), ("[\n]: x\n\n[\n]", "[ ]: x [ ] "), ("[*a](b)*", "*a* "), ("*a [b*](c)", "*a b* "), ("[a`](b)`", "[a "), ("[a\\]](b)", "a] "), ("[a](b \"\\\"\")", "a "),
    ("> [a]: x\n\n[a]", "a "), ("x[^1]\n\n[^1]: n\n    more\n\n    again\n\nend", "x n more again end "), ("x[^2]", "x[^2] "), ("[a]\n\n[A  b]: x", "[a] "), ("[a\nB]\n\n[A  b]: x", "a B "), ("]", "] "), ("[", "[ "),
    # emphasis and code spans
    ("*a*b*", "ab* "), ("**a*", "*a "), ("*a**", "a* "), ("***a***", "a "), ("*a **b** c*", "a b c "), ("**a *b* c**", "a b c "), ("*(**a**)*", "(a) "), ("a * b * c", "a * b * c "), ("a*\"b\"*", "a*\"b\"* "), ("5*6*78", "5678 "),
    ("_a_b", "_a_b "), ("a_b_", "a_b_ "), ("_(a)_.", "(a). "), ("a__b__", "a__b__ "), ("пр_а_", "пр_а_ "), ("*a_b*_", "a_b_ "), ("*a _b* c_", "a _b c_ "), ("**a* b*", "a b "), ("****a****", "a "), ("**a\n\nb**", "**a b** "), ("*a\nb*", "a b "),
    ("* a*", "a*"), ("~a~~", "~a~~ "), ("~~a~~ ~b~ ~~~c~~~", "a b ~~~c~~~ "), ("`` a`b ``", " "), ("`a\nb` c", " c "), ("``a`", "``a` "), ("`*a`*", "* "), ("\\`a`", "`a` "), ("*`a*`", "* "[:0] + "* "), ("€*a*", "€a "), ("a*£b*", "a*£b* "),
    # breaks, entities, autolinks, HTML in lines
    ("a  \nb\\\nc", "a b c "), ("a\\", "a\\ "), ("a   \n   b", "a b "), ("&nbsp;&#35;&#x41;&#0;&x;&copy", "\xa0#A�&x;&copy "), ("&#42;a&#42;", "*a* "), ("&#1234567;", "� "), ("<m@x.y> <xx:y> <x y:z> <>", "m@x.y xx:y  <> "), ("a<br/>b <1> </b >", "ab <1>  "),
    ("a <!-- b\nc --> d", "a  d "), ("a <? b ?> <!X y> <![CDATA[>&]]>z", "a   z "), ("<a b=\"*\">*c*</a>", "c "), ("\ta", ""), ("a\r\n\r\nb\rc", "a b c "), (" \n\t\n", ""),
    # tables
    ("|a|b|\n|-|-|\n|c|\n|d|e|f|\n> g", "abcdeg "), ("a|b\n-|-\n\nc", "abc "), ("a|b\n-|-|-\nc", "a|b -|-|- c "), ("x\na|b\n-|-", "x a|b -|- "), ("|`a\\|b`|*c*|\n|:-:|--:|", "c"), ("> |a|\n> |-|\n> |b|\nc", "abc "), ("|a|\n|-|\nb\n# c\nd", "abd "), ("- |a|\n  |-|\n  |b|", "ab"),
])
def test_prose(text, want):
    assert prose_of(text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("# a\n## b ##\n### c#\n#### d \\#\n##### *e* `f*` #####\n###### ###", [(1, "a"), (2, "b"), (3, "c#"), (4, "d #"), (5, "e f*"), (6, "")]), ("a\nb\n==\n\nc\n--\n\nd\n\n--", [(1, "ab"), (2, "c")]), ("    # a\n   # b", [(1, "b")]),
    ("> # a\n- # b\n  c\n  ---", [(1, "a"), (1, "b"), (2, "c")]), ("> a\n===", []), ("- a\n===", []), ("[a]: x\n[b]: y\nc\n===", [(1, "c")]), ("---\nt: 1\n---\n# a", [(1, "a")]), ("\u2003\n---\nt\n---\n# a", [(1, "a")]), ("```\n# a\n```\n<div>\n# b\n\n# c", [(1, "c")]),
    ("# [a][^1] ![b](c)\n\n[^1]: x", [(1, "a b")]), ("#\ta\n##", [(1, "a"), (2, "")]), ("`a\n---\nb`", [(2, "`a")]), ("# a  \n# &amp;", [(1, "a"), (1, "&")]),
])
def test_headings(text, want):
    assert HEADS(text) == want


def test_ranges():
    text = "é\n\n> |a|b|\n> |-|-|\n> |é|d|\n\nx\n\n- e|f\n  -|-\n  g|h\n- i"
    data = text.encode()
    assert [data[r["start"] : r["end"]].decode() for r in table_ranges_of(text)] == ["|a|b|\n> |-|-|\n> |é|d|", "e|f\n  -|-\n  g|h"]


def test_nothing_is_lost_and_nothing_is_slow():
    """Words outside of headings and code come through any wrapping; hostile texts take time in proportion."""
    rng = random.Random(7)
    wraps = [lambda s: "> " + s.replace("\n", "\n> "), lambda s: "- " + s.replace("\n", "\n  "), lambda s: "7. " + s.replace("\n", "\n   "), lambda s: s + "\n\n" + s.upper(), lambda s: re.sub("([a-f]) ([a-f])", r"\1 *x* \2", s, count=1), lambda s: "[" + s + "](u)" if "\n\n" not in s and "[" not in s and s[:1].isalpha() else s]
    for _ in range(300):
        text = " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(rng.randint(2, 6))) + ("\nlast" if rng.random() < 0.5 else "")
        for _ in range(rng.randint(1, 6)):
            text = rng.choice(wraps)(text)
        plain = [w.strip("*[]()") for w in re.sub(r"\]\([uU]\)", " ", text).split() if w not in (">", "-", "7.")]
        assert sorted(prose_of(text).replace(" ", "")) == sorted("".join(p for p in plain if p)), text
    for text in ("[" * 20000, "*a **b " * 20000, "`" * 9 + "`a``b```c" * 9000, "> " * 300 + "a", "[a](" * 20000, "<" * 20000, "a\n" * 30000, "|a|b|\n|-|-|\n" + "|c|d|\n" * 20000, "- " * 2000 + "a", "_a" * 20000, "![" * 10000 + "](u)" * 10000):
        began = time.time()
        prose_of(text)
        assert time.time() - began < 5, text[:20]
