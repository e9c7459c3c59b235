"""Functions for Python workers load where this package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle

from terrane.operators import neighbours, tsne


def test_functions_travel_by_value(tmp_path):
    path = tmp_path / "functions"
    path.write_bytes(cloudpickle.dumps((tsne.repulsion, neighbours._top, neighbours._leaf_of)))
    script = (
        "import pickle, sys\n"
        f"functions = pickle.load(open({str(path)!r}, 'rb'))\n"
        "assert len(functions) == 3 and 'terrane' not in sys.modules\n"
    )
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert run.returncode == 0, run.stderr
