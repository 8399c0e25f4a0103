import subprocess
import sys

import __spark_entry__

SCRIPT = "import sys; sys.modules['{name}'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def counts(name):
    """Numbers of queries and of SQL where a module cannot be imported."""
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(name=name)], capture_output=True, text=True, check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
    return run.stdout.split()


def test_guard():
    """Without the training-data operators, or a library of theirs, the rest is there."""
    from concord import registry

    core = [str(len(registry.QUERIES)), str(len(registry.ORACLES)), "False"]
    for name in ("concord.llm", "concord.llm.registry"):
        assert counts(name) == core, name


def test_all_have_sql():
    from concord import registry

    assert set(registry.QUERIES) == set(registry.ORACLES)
