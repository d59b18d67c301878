import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()


def test_imports_without_a_session():
    names = run("import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())")
    assert "network_report" in names


def test_the_rest_works_without_the_corpus_subpackage():
    names = run(
        "import sys; sys.modules['laneweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*e.queries())"
    )
    assert "network_report" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_flagship(spark):
    import __spark_entry__ as e

    rows = {r.area_id: r for r in e.entry(spark).collect()}
    assert len(rows) == 25 and (rows[0].nodes, rows[0].edges, rows[0].dead_ends, rows[0].segments, rows[0].score, rows[0].length_m) == (98, 75, 54, 87, 34, 2509.07)
