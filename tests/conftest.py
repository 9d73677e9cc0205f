import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

SUBAGENT = (
    "row_id long, session string, parent_session string, line_no int, type string, issidechain boolean, logged_at string, ingested_at timestamp, "
    "message struct<id:string,content:array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,items:array<struct<type:string,text:string>>,is_error:boolean>>,"
    "usage:struct<input_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>>, side string, role string, value string, part string, stretch int"
)


def block(kind, **fields):
    return {"type": kind, **fields}


def use(id_, name, input_="{}"):
    return block("tool_use", id=id_, name=name, input=input_)


def result(id_, content="", **fields):
    return block("tool_result", tool_use_id=id_, content=content, **fields)


def said(text):
    return block("text", text=text)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def transcript(spark):
    """Makes a table of transcript rows from ``(row_id, session, line_no, type, side, logged_at, blocks)``; with columns that clash."""

    def make(rows):
        fields = ("type", "text", "thinking", "id", "name", "input", "tool_use_id", "content", "items", "is_error")
        out = []
        for row_id, session, line_no, kind, side, logged_at, blocks in rows:
            content = None if blocks is None else [tuple(b.get(f) for f in fields) for b in blocks]
            out.append((row_id, session, None, line_no, kind, side, logged_at, None, (None, content, None), "x", "y", "z", "w", 1))
        return spark.createDataFrame(out, SUBAGENT)

    return make
