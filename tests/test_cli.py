"""The command line over every format."""

import io

import pytest

from tests.test_corpus import FIRST, META, SECOND, YAML
from tierlake import cli
from tierlake.corpus import Corpus


def test_load_convert_and_show(spark, tmp_path):
    pytest.importorskip("yaml")
    at = lambda name: str(tmp_path / name)
    (tmp_path / "a.yaml").write_text(YAML)
    cli.main(["load", at("a.yaml"), at("store")])
    assert Corpus.read(spark, at("store")).to_yaml_str() == YAML
    for name in ("b.json", "c.cuac", "d.yaml"):
        cli.main(["convert", at("store"), at(name)])
        assert Corpus.read(spark, at(name)).to_yaml_str() == YAML, name
    cli.main(["convert", at("store"), at("e.jsonl")])
    cli.main(["load", at("e.jsonl"), at("again"), "--jsonl", "--meta", at("a.yaml")])
    assert sorted(Corpus.read(spark, at("again")).order) == ["9wpe", "Kjco"]
    (tmp_path / "wrong.yaml").write_text(YAML.replace("Kjco", "Kjcx"))
    cli.main(["convert", at("wrong.yaml"), at("f.json"), "--ignore-id-errors"])
    cli.main(["show", at("a.yaml"), "--doc-id", "Kjco"], out := io.StringIO())
    assert out.getvalue().startswith("=== Kjco ===\ntext: This is a document.\n\nwords: This is  a  document .\npos  : DT   VBZ DT NN       .")
    with pytest.raises(SystemExit):
        cli.main(["load"])
    assert set(META) == {"text", "words", "pos"} and FIRST["pos"] != SECOND["pos"]
