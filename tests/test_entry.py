"""The driver's contract, and that the rest works without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tideloom import storage

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")
SAMPLE = ["events_graph", "orders_graph", "slide_boundaries", "coalesce", "join_ts", "vt_join_st", "pair_join", "vt_query2", "bs_query3_a", "deltas", "vt_query6_cq", "orders_path", "read_edges_s", "read_edges_it", "stream_join", "metrics"]


def test_every_query_has_a_source_that_stands_alone():
    """The package without its subpackage of corpus operators: copied elsewhere, it imports and lists its queries."""
    code = (
        "import sys, shutil, tempfile, pathlib\n"
        f"root = pathlib.Path({str(ROOT)!r}); to = pathlib.Path(tempfile.mkdtemp())\n"
        "shutil.copytree(root / 'tideloom', to / 'tideloom', ignore=shutil.ignore_patterns('llm', '__pycache__'))\n"
        "shutil.copy(root / '__spark_entry__.py', to)\n"
        "sys.path[:] = [str(to)] + [p for p in sys.path if p not in ('', str(root))]\n"
        "import __spark_entry__ as e\n"
        "assert not any(q.startswith('op') and q[2].isdigit() for q in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/")


def test_a_library_that_only_the_corpus_operators_need_may_be_absent():
    code = (
        "import sys, warnings\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "sys.modules['xxhash'] = None\n"
        "with warnings.catch_warnings(record=True) as told:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as e\n"
        "assert len(e.queries()) > 80 and 'pipeline' not in e.queries() and any('xxhash' in str(w.message) for w in told)\n"
    )
    if (ROOT / "tideloom" / "llm").exists():
        subprocess.run([sys.executable, "-c", code], check=True, cwd="/")


def test_a_local_folder_is_refused_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert storage.shared_dir(Session).startswith("file://")


@pytest.mark.skipif(not SMALL.exists(), reason="needs the small tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_sql(spark, name):
    import __spark_entry__ as entry

    db = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = entry.queries()[name](spark, str(SMALL))
    names = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(names).collect()), key=repr)
    expected = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == expected


@pytest.mark.skipif(not SMALL.exists(), reason="needs the small tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["src", "trg", "vs", "ve"]
