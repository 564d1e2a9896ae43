import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

from atlaskb.plans import catalogue

from .oracle import DATA, expected, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    columns, rows = rows_of(catalogue.QUERIES[name](spark, DATA))
    if name in catalogue.SQL:
        assert (columns, rows) == expected(catalogue.SQL[name])
    else:
        assert rows


REPEATED = [
    (0, "http://a.example.com/en/1", "x"), (1, "http://a.example.com/en/1", "y"), (2, "http://a.example.com/en/2", "z"), (3, "http://a.example.com/en/1", "x"),
    (4, "http://a.example.com/en/3", "v"), (5, "http://a.example.com/en/3", "w"), (6, "http://a.example.com/en/4", "u"), (9, "http://a.example.com/en/4", "t"),
]


@pytest.mark.parametrize("name", ["changed_semi", "index_merge", "page_text_dom", "skip_existing", "stale_anti"])
def test_pages_that_share_a_url_and_broken_references(spark, tmp_path, name):
    page = "<html><head><title>%s one&amp;&amp</title></head><body><article><p>Some text &amp; %s more of it &amp</p></article></body></html>"
    rows = [(i, u, page % (x, x)) for i, u, x in REPEATED]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert rows_of(catalogue.QUERIES[name](spark, str(tmp_path))) == expected(catalogue.SQL[name], str(tmp_path))


ABSENT = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in %r:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__
from atlaskb.plans import catalogue
assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalogue.SQL)
"""


@pytest.mark.parametrize(("hidden", "fine"), [(("atlaskb.llm",), True), (("corpus_pipeline", "atlaskb.llm"), True), (("regex",), False)])
def test_entry_without_the_optional_part(hidden, fine):
    """Without the operators the rest stays; without a library that something needs, the import fails."""
    done = subprocess.run([sys.executable, "-c", ABSENT % (hidden,)], capture_output=True, cwd=Path(__file__).parent.parent, check=False)
    present = importlib.util.find_spec("atlaskb.llm") is not None
    assert (done.returncode == 0) == (fine or not present)
