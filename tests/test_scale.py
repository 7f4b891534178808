"""Work that has to be spread over tasks and kept in small pieces, whatever the size of the table."""

from __future__ import annotations

import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest

from paperloom import plans
from paperloom.functions import html, text
from paperloom.plans import reader_queries, registry
from paperloom.sources import containers as N
from paperloom.sources.builders import archive, build_xlsx


@pytest.mark.parametrize("name", ["q_page_markdown", "q_xlsx_cells", "q_xls_cells", "q_docx_markdown"])
def test_costly_rows_of_a_narrow_table_are_many_tasks(spark, sf, name, monkeypatch):
    dealt = []
    monkeypatch.setattr(reader_queries, "spread", lambda rows, *keys: dealt.append(registry.spread(rows, *keys)) or dealt[-1])
    plans.QUERIES[name](spark, sf)
    assert dealt and all(x.rdd.getNumPartitions() > 4 for x in dealt)


def test_readers_give_out_few_rows_at_a_time():
    """Frames that a task makes of one batch of many files have a bounded number of rows."""
    kept = {}

    class Found:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _schema):
            kept.setdefault("runs", []).append(run)
            return self

    book = build_xlsx([{"name": "S", "rows": [["a", 1, 2]] * 50}])
    N.read_sheets(Found(), "xlsx")
    batch = pd.DataFrame({"path": [str(k) for k in range(40)], "content": [book] * 40})
    sizes = [len(x) for x in kept["runs"][0](iter([batch, batch]))]
    assert sum(sizes) == 2 * 40 * 150 and max(sizes) <= N.ROWS_OUT
    made = archive({"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>' + "x" * 200_000 + "</w:t></w:r></w:p></w:body></w:document>"})
    kept.clear()
    N.read_text(Found(), "docx")
    texts = pd.DataFrame({"path": [str(k) for k in range(40)], "content": [made] * 39 + [None]})
    sizes = [len(x) for x in kept["runs"][0](iter([texts]))]
    assert sum(sizes) == 40 and max(sizes) <= 11


def test_a_batch_of_long_texts_is_not_python_objects_at_once():
    texts, pages = pa.array(["é" * 10_000] * 2000), pa.array([b"<p>x</p>" * 2500] * 2000)
    for f, columns, first in ((text.nfc.func, [texts], "é" * 10_000), (html.decoded.func, [pages, pa.nulls(2000, pa.string())], "<p>x</p>" * 2500)):
        tracemalloc.start()
        made = f(*columns)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(made) == 2000 and made[0].as_py() == made[1999].as_py() == first and peak < 10e6
    assert text.nfc.func(pa.array([], pa.string())).to_pylist() == [] and text.nfc.func(pa.array([None, ""])).to_pylist() == [None, ""]
