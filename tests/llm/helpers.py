import os
import re

TESTDATA = os.environ.get("LOREKEEP_TESTDATA", "/root/testdata")
SMALL = f"{TESTDATA}/sf0.001"


def docs(spark, rows, extra=True):
    """A documents table with an extra column whose name operators might use themselves."""
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    return frame if extra else frame.drop("score")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}
