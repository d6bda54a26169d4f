import numpy as np

from veilstream.operators import cells, chunks

SHAPE = "chunk_id long, vector array<double>"


def compare(spark, rows, asked, k, block, **how):
    df, q = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(asked, SHAPE.replace("chunk_id", "query_id"))
    found, share = cells.top_by_cells(q, cells.vector_cells(df, **how), k, block)
    rowset = lambda d: [(r.query_id, r.rank, r.chunk_id, r.similarity) for r in d.orderBy("query_id", "rank").collect()]
    got, want = rowset(found), rowset(chunks.top_chunks(q, df, k))
    assert got == want
    return share, len(got)


def test_clustered_vectors_leave_most_out(spark):
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(20, 16))
    rows = [(i, (middle[i % 20] + 0.05 * draw.normal(size=16)).tolist()) for i in range(3000)]
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    share, n = compare(spark, rows, asked, 5, 16, centres=20)
    print("left out:", share)
    assert n == 5 * 60 and share > 0.8


def test_unclustered_vectors_and_odd_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.0] * 8) for i in range(5)] + [(2000, None), (7, rows[7][1])] + [(3000 + i, [1.0] * 8) for i in range(20)]
    asked = [(1, rows[1][1]), (2, [0.0] * 8), (3, None), (4, [1.0] * 8), (5, [-1.0] * 8)]
    for k, centres in ((3, 10), (30, 4), (500, 10)):
        compare(spark, rows, asked, k, 2, centres=centres, sample=50)


def test_empty_tables(spark):
    one = [(1, [1.0, 0.0])]
    assert compare(spark, [], one, 3, 5)[1] == 0
    assert compare(spark, one, [], 3, 5)[1] == 0
    assert compare(spark, [(1, [0.0, 0.0]), (2, None)], one, 3, 5)[1] == 1
