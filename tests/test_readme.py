"""The README's example, run as printed (with its folder moved to a temporary one)."""

import os
import re

from conftest import ROOT


def test_example_runs(spark, tmp_path):
    with open(os.path.join(ROOT, "README.md"), encoding="utf-8") as f:
        code = re.search(r"```python\n(.*?)```", f.read(), re.S).group(1)
    (tmp_path / "qa_pairs").mkdir()
    (tmp_path / "rules_simple.txt").write_text("1. Tickets are sold online.\n2. Refunds within 7 days.\n3. Children ride free.\n")
    (tmp_path / "qa_pairs" / "rules_simple_qa_pairs.txt").write_text("Q: Where are tickets sold?\nA: ['online']\nQ: Who rides free?\nA: ['children']\n")
    code = code.replace('"data', f'"{tmp_path}').replace('"results', f'"{tmp_path}/results')
    names: dict = {}
    exec(code, names)                                        # noqa: S102
    assert names["docs"].count() == 1 and names["rejects"].count() == 0
    rows = {r.chunking_strategy_name: r for r in names["result"].collect()}
    assert len(rows) == 2 and all(r.n_questions == 2 for r in rows.values())
    assert rows["recursive_char_split_1"].reranker_model == "lexical"
    assert list((tmp_path / "results" / "summary").glob("experiment_results_*/*.csv"))
