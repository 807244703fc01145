"""The functions of this package under their names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .css import DECL, css_declarations, parse_css
from .html import NODE, as_rows, html_nodes, parse_html
from .js import config_json, js_outline
from .similarity import ratio_udf, round2, round3
from .tree import tree_elements


def _table(name: str, schema, rows):
    """A table function of one text: a row for each row that the parser yields."""
    class Rows:
        def eval(self, content: str):
            yield from rows(content)

    Rows.__name__ = name
    return F.udtf(Rows, returnType=schema)


def _declaration_rows(content):
    return parse_css(content)


def _node_rows(content):
    for n in as_rows(parse_html(content)):
        yield tuple(n.values())


def register(spark: SparkSession) -> None:
    for name, f in {
            "ratio": ratio_udf, "round2": round2, "round3": round3, "parse_html": html_nodes, "parse_css": css_declarations, "parse_js": js_outline,
            "config_json": config_json, "tree_compare": tree_elements()}.items():
        spark.udf.register(name, f)
    spark.udtf.register("css_decls", _table("CssDecls", DECL, _declaration_rows))
    spark.udtf.register("html_nodes", _table("HtmlNodes", NODE, _node_rows))
