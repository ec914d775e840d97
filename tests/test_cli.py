import json

import pytest

from gatehouse import cli
from gatehouse.plans import experiments


def test_commands(spark, tmp_path, capsys):
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join(json.dumps({"id": str(i), "text": f"The committee of {1990 + i} met in the city.", "source": "web"}) for i in range(3)) + "\n")
    for command, expect in (("profile", "char_length"), ("curate", "label_name"), ("report", "3 documents")):
        cli.main([command, str(path)], spark)
        assert expect in capsys.readouterr().out
    cli.main(["gate", "json", '{"a": 1'], spark)
    assert json.loads(capsys.readouterr().out)["gate_passed"] is False
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_robust_outliers_catch_every_injected_one(spark):
    got = experiments.outlier_methods(spark, 160)
    assert got["robust"]["recall"] == 1.0 and got["robust"]["f1"] > 0.85 and 0 <= got["k_sigma"]["f1"] <= 1


def test_gates_hold_on_both_slices(spark):
    got = experiments.gate_oracle(spark, 16, range(2))
    assert all(v["floor"] <= v["upper"] + 0.05 and v["guard_fpr"] <= 0.15 for v in got.values()) and got["json"]["floor"] > 0.9
