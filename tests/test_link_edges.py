"""Edges of the links that a page shows."""

from tessera.operators import links

BODY = """# A
See [[services/my-api]] and [[The API|services/my-api]], [[services/my-api]] again.
[ up \tthere](../b.md "title") [gone](<missing page.md>) [frag](/b#part) [![img](/x.png) text](/b)
[mail](mailto:a@b.c) [self](#top) [ftp](ftp://h/x) [](/b) [out](../../../x)
https://example.org/a?b=1). <https://example.org/c> [site](https://example.org/d)
`[[code/span]]` ``[x](/b)``
~~~
[[fenced/page]] https://example.org/no
~~~
[[Label only|]] [[https://example.org/w]] ![[b]]
"""


def test_edges_of_all_forms(spark):
    pages = spark.createDataFrame([("x/a", "A", BODY, 1), ("b", "Bee", "[[b]] [[x/a]]", 2), ("services/my-api", None, None, 3), ("e", "E", "", 4)], "page_id string, title string, body string, label int")
    rows = [tuple(r) for r in links.link_edges(pages).collect()]
    got = {r[2:] for r in rows if r[0] == "x/a"}
    api, bee = ("services/my-api", None, "/services/my-api"), ("b", "Bee", "/b")
    for wanted in [
        (*api, "My Api", True, False), (*api, "The API", True, False), (*bee, "up there", True, False), ("b", "Bee", "/b#part", "frag", True, False), (*bee, None, True, False),
        (None, None, "mailto:a@b.c", "mail", True, True), (None, None, "#top", "self", True, True), (None, None, "ftp://h/x", "ftp", True, True), (None, None, "../../../x", "out", True, True),
        (None, None, "https://example.org/a?b=1", "https://example.org/a?b=1", True, True), (None, None, "https://example.org/c", "https://example.org/c", True, True), (None, None, "https://example.org/d", "site", True, True),
        (None, None, "missing page.md", "gone", True, True), (None, None, "https://example.org/w", "W", True, True),
    ]:
        assert wanted in got, wanted
    assert not any("code" in r[2] or "fenced" in r[2] or r[2].endswith("/no") or "png" in r[2] for r in got)
    assert [r[0] for r in rows] == sorted(r[0] for r in rows) and len(rows) == len(set(rows))
    key = [(r[0], r[2] or "", r[4], r[5] or "") for r in rows]
    assert key == sorted(key) and {r[0] for r in rows} == {"x/a", "b"}
    assert links.link_edges(pages.filter("false")).count() == 0
