"""Lines that the order leaves tied come as they stand in the table, however its files are dealt."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from lectern.plans import facets


def test_tied_lines_keep_the_order_of_the_table(spark, tmp_path):
    """The second file is larger, so that it is read first; the tied line of the first file comes before that of the second all the same."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    day = lambda k: datetime(2020, 1, k)
    schema = pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_linestatus", pa.string()), ("l_shipdate", pa.timestamp("us"))])
    first = [(1, 1, "F", day(1))]
    second = [(1, 1, "O", day(1)), (1, 1, "O", day(9))] + [(k, 1, "O", day(1)) for k in range(2, 5000)]
    for name, rows in (("part-0.parquet", first), ("part-1.parquet", second)):
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema), folder / name)
    got = {r.l_linestatus: (r.median_gap, r.gaps) for r in facets.median_gap(spark, str(tmp_path)).collect()}
    assert got == {"F": (0.0, 1), "O": (8.0, 1)}
