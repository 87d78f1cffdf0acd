import re

import pytest
from pyspark.sql import functions as F

from vitaespark.functions import html as H

TAGS = "div|p|h3|h2|span|li|ul|ol|b|i|em|strong"


@pytest.mark.parametrize("text", [
    "<p>a<p>b</p>", "</div> </p><div>x</div></div>", "<h3>t</h3></h3>\n</h3> ", "<div><p>a</p></div>", "<span>x",
    "a\n\n\n\nb</span></span>tail", "</p>\n\n</div>", "<p >q</p></p></p> z",
])
def test_repair_steps(value, text):
    stripped = re.sub(rf"(\s*</(?:{TAGS})>\s*)+$", "", re.sub(rf"^(\s*</(?:{TAGS})>\s*)+", "", text.strip()))
    assert value(H.strip_orphan_closers, text) == stripped
    balanced = text
    for tag in ("div", "p", "h3", "span"):
        excess = balanced.count(f"</{tag}>") - len(re.findall(rf"<{tag}[\s>]", balanced))
        for _ in range(max(excess, 0)):
            balanced = re.sub(rf"\s*</{tag}>\s*$", "", balanced)
        balanced += f"</{tag}>" * max(-excess, 0)
    assert value(H.balance_tags, text) == balanced


def test_counts_and_flags(spark):
    row = spark.createDataFrame([("<p>a<p>b</p><pre>",)], "h string").select(
        H.tag_opens(F.col("h"), "p").alias("o"), H.tag_closes(F.col("h"), "p").alias("c"),
        H.has_html_tag(F.col("h")).alias("x"), H.has_body_tag(F.lit("<BODY >")).alias("b")).first()
    assert (row.o, row.c, row.x, row.b) == (2, 1, False, True)


def test_collapse_escape_newlines(value):
    assert value(H.collapse_closers, "a</div>\n</p>b") == "a</p>b"
    assert value(H.escape_html, "<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert value(H.escape_html, None) == ""
    assert value(H.collapse_newlines, "a\n\n\n\nb") == "a\n\nb"
