"""Queries of the subpackage in a session whose workers do not know the repository."""

from __future__ import annotations

import os
import subprocess
import sys

from siteroster.llm.registry import entries

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from siteroster.session import build_session
from siteroster.llm.registry import entries
spark = build_session("local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}})
for name in ("op11_conversation_repair", "op13_centroid_clustering", "op3_simhash_near_dedup", "op7_lm_scoring"):
    print(name, entries()[name][0](spark, "/root/testdata/sf0.001").count())
"""


def test_tasks_carry_their_code(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-3000:]
    assert [int(line.split()[1]) > 0 for line in out.stdout.splitlines() if line.startswith("op")] == [True] * 4


def test_every_operator_has_its_query():
    names = list(entries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
