"""Markdown blocks and inline tokens: every construct, and texts that look like one."""

import random

import pytest

from graphloom.sources import markdown

TEXT = """# Title *x*

para one
  goes on `c` and **b**
> quoted
>  more
- [x] done @me
- [ ] open
- plain
* star
1. one
2. two
***
| a | b |
|---|:-:|
| 1 | 2 |
| 3 |
```py
 code | x
- not a list
```
#tag alone
| no table |
##### five
```
never closed"""


def test_blocks():
    got = [(b[0], b[1], b[2], b[3] or b[4] or b[5], b[6] if b[6] is not None else b[7]) for b in markdown.blocks(TEXT)]
    assert got == [
        (0, None, "heading", 1, "Title *x*"), (1, None, "blank", None, None), (2, None, "paragraph", None, "para one goes on `c` and **b**"), (3, None, "quote", None, "quoted\n more"),
        (4, 0, "task", True, "done @me"), (4, 1, "task", False, "open"), (5, 0, "bullet", None, "plain"), (5, 1, "bullet", None, "star"), (6, 0, "numbered", None, "one"), (6, 1, "numbered", None, "two"),
        (7, None, "rule", None, None), (8, 0, "table", None, ["a", "b"]), (8, 1, "table", None, ["1", "2"]), (8, 2, "table", None, ["3"]), (9, None, "code", "py", " code | x\n- not a list"),
        (10, None, "paragraph", None, "#tag alone"), (11, None, "paragraph", None, "| no table |"), (12, None, "paragraph", None, "##### five"), (13, None, "code", "text", "never closed"),
    ]


def test_inlines():
    t = "a **b** __c__ *d* _e_ ~~f~~ `g*` [h](https://x) [i](javascript:1) [j]( ./k ) @l #m-1 ** n"
    got = markdown.inlines(t)
    assert "".join(x["raw"] for x in got) == t
    assert [(x["kind"], x["content"], x["href"]) for x in got if x["kind"] != "text"] == [
        ("bold", "b", None), ("bold", "c", None), ("italic", "d", None), ("italic", "e", None), ("strikethrough", "f", None), ("code", "g*", None), ("link", "h", "https://x"),
        ("link", "i", "#"), ("link", "j", "./k"), ("mention", "@l", None), ("tag", "#m-1", None),
    ]


@pytest.mark.parametrize("seed", range(5))
def test_parts_tile_the_text(seed):
    r = random.Random(seed)
    for _ in range(200):
        text = "".join(r.choice(["\n", "#", " ", "-", "*", "|", "`", "```", ">", "1. ", "[x]", "a", "bc", "_", "\r"]) for _ in range(r.randint(0, 40)))
        parts = markdown.blocks(text)
        assert "".join(text[b[8] : b[9]] for b in parts) == text
        assert all("".join(x["raw"] for x in markdown.inlines(b[6])) == b[6] for b in parts if b[6])


def test_table(spark):
    docs = spark.createDataFrame([(1, TEXT, "k"), (2, None, "k"), (3, "", "k"), (4, "same", "k"), (4, "same", "k")], "id long, text string, kind_of string").repartition(2)
    got = markdown.markdown_blocks(docs)
    assert got.filter("id = 1").count() == 19 and got.filter("id = 2").count() == 0
    assert [(r.kind, r.begin, r.until) for r in got.filter("id = 3").collect()] == [("blank", 0, 0)]
    assert [[x.kind for x in r.inlines] for r in got.filter("id = 1 and nth = 2").collect()] == [["text", "code", "text", "bold"]]
    assert got.filter("id = 4").count() == 2
    assert markdown.markdown_blocks(docs.filter("false")).count() == 0
