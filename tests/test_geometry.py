import numpy as np
from pyspark.sql import functions as F

from strandline.functions import geometry as g


def test_rings(spark):
    arcs = [g.decoded([[0, 0], [10, 0], [0, 10]], (0.5, 0.5), (1, 1)), g.decoded([[10, 10], [-10, 0]], (0.5, 0.5), (1, 1))]
    assert arcs[0].tolist() == [[1, 1], [6, 1], [6, 6]]
    assert g.stitched([0, 1], arcs).tolist() == [[1, 1], [6, 1], [6, 6], [1, 6]] and g.stitched([~0], arcs).tolist() == [[6, 6], [6, 1], [1, 1]]
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    inside = g.clipped(square, (1, 1, 3, 5))
    area = lambda r: abs(np.dot(r[:, 0], np.roll(r[:, 1], 1)) - np.dot(r[:, 1], np.roll(r[:, 0], 1))) / 2
    assert area(inside) == 6 and g.clipped(square, (5, 5, 6, 6)).size == 0 and area(g.clipped(square, (-1, -1, 9, 9))) == 16
    triangle = np.array([[0, 0], [4, 0], [0, 4]], float)
    assert area(g.clipped(triangle, (0, 0, 2, 2))) == 4
    assert len(g.thinned(np.array([[0, 0], [0.01, 0], [1, 0], [1, 1], [0, 1]]))) == 4 and g.thinned(triangle).size == 0
    df = spark.createDataFrame([(square.tolist(),), (None,)], "r array<array<double>>")
    rows = df.select(g.ring_in_box(F.col("r"), (1, 1, 3, 3)).alias("o")).collect()
    assert area(np.array(rows[0].o)) == 4 and rows[1].o is None
