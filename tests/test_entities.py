"""Character references against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from boutline.functions.entities import unescape
from boutline.operators import textops as X


def test_every_reference_as_the_standard_says(spark):
    rng = random.Random(2)
    texts = [f"a &{n} b&{n}c" for n in sorted(html5)] + [f"x&#{n};y" for n in [*range(0, 300), 8217, 8230, 0x1F600, 55296, 1114111, 1114112, 65534, 64976, 10**15]]
    texts += [f"&#x{n:x};&#X{n:X}" for n in (0x27, 0x80, 0x9F, 0x2019, 0x1F600, 0xD800, 0x110000, 0)] + ["&", "&&", "& amp;", "&amp;lt;", "&#;", "&#x;", "&#00065;", "&notit; &notin;", "&unknown;", "AT&T &hellip;&mdash;&eacute;", "", "plain", None]
    parts = ["&", "amp", "lt", ";", "#", "x", "27", "eacute", " ", "not", "in", "Z", "&nbsp"]
    texts += ["".join(rng.choice(parts) for _ in range(12)) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescape(F.col("t")).alias("u")).collect()
    for r in got:
        t = texts[r.i]
        assert r.u == (None if t is None else html.unescape(t)), t


def test_pages_with_other_references(spark):
    page = "<h2>Caf&eacute; &#8217;s</h2><p>a &hellip; b &#x27;c&#39; &amp;lt; &mdash;&nbsp;d</p>"
    rows = X.page_blocks(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").orderBy("pos").collect()
    assert [(r.kind, r.text) for r in rows] == [("h2", "Café ’s"), ("p", "a … b 'c' &lt; — d")]
