"""Functions for SQL: table functions for grids and boxes, and a robust-deviation aggregate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chirplake.config import FILE_SECONDS


def register(spark: SparkSession) -> None:
    """Register offsource_points(fid, halfwin, step), box_corners(line, width, height) and robust_sigma(x) in a session."""

    @F.udtf(returnType="gps: double")
    class OffsourcePoints:
        def eval(self, fid: int, halfwin: float, step: float):
            start, stop = fid * FILE_SECONDS + halfwin, (fid + 1) * FILE_SECONDS - halfwin
            for k in range(int((stop - start) // step) + 1):
                yield (start + k * step,)

    @F.udtf(returnType="class_id: int, left: double, top: double, right: double, bottom: double")
    class BoxCorners:
        def eval(self, text: str, width: int, height: int):
            for line in (text or "").splitlines():
                if len(parts := line.split()) == 5:
                    c, (x, y, w, h) = int(float(parts[0])), map(float, parts[1:])
                    yield c, (x - w / 2) * width, (y - h / 2) * height, (x + w / 2) * width, (y + h / 2) * height

    @F.pandas_udf("double")
    def robust_sigma(x: pd.Series) -> float:
        mad = (x - x.median()).abs().median()
        return float(1.4826 * mad if mad > 0 else x.std(ddof=0))

    spark.udtf.register("offsource_points", OffsourcePoints)
    spark.udtf.register("box_corners", BoxCorners)
    spark.udf.register("robust_sigma", robust_sigma)
