"""The command line: exit codes, formats, sources."""

import json

import pytest

from sparkpolicy.cli import main

DENY = "package p\ndeny contains m if { some p in input.ports; p == 22; m := \"ssh is open\" }\n"
ALLOW = "package p\nallow if input.user == \"admin\"\n"


@pytest.fixture
def files(tmp_path):
    def make(policy, config, name="c.json"):
        (tmp_path / "p.txt").write_text(policy)
        (tmp_path / name).write_text(config if isinstance(config, str) else json.dumps(config))
        return ["--policy", str(tmp_path / "p.txt"), "--config", str(tmp_path / name)]

    return make


def test_exit_codes(files, capsys):
    assert main(files(ALLOW, {"user": "admin"})) == 0
    assert main(files(ALLOW, {"user": "bob"})) == 1
    assert "undefined" in capsys.readouterr().out
    assert main(files(DENY, {"ports": [22]})) == 1
    assert main(files(DENY, {"ports": [80]})) == 1  # an empty set of denials is undefined
    assert main(files("package p\na := ]", {})) == 2
    assert main(files(ALLOW, "{not json")) == 2
    assert main(["--policy", "x"]) == 2
    assert main(files("package p\nx := 1", {})) == 2  # no query to infer


def test_json_format(files, capsys):
    assert main([*files(DENY, {"ports": [22]}), "--format", "json", "--profile"]) == 1
    out = capsys.readouterr()
    assert json.loads(out.out) == {"success": False, "errors": ["ssh is open"], "result": ["ssh is open"]}
    assert "profile evaluate" in out.err


def test_query(files):
    assert main([*files("package p\nx := true\ny := {}\nz := {\"a\": 1}", {}), "--query", "data.p.x"]) == 0
    assert main([*files("package p\ny := {}", {}), "--query", "data.p.y"]) == 0
    assert main([*files("package p\nz := {\"a\": 1}", {}), "--query", "data.p.z"]) == 1


def test_yaml(files):
    pytest.importorskip("yaml")
    assert main(files(ALLOW, "user: admin\n", "c.yaml")) == 0
    assert main(files(ALLOW, "a: &x admin\nuser: *x\n", "c.yaml")) == 2
    assert main([*files(ALLOW, "a: &x admin\nuser: *x\n", "c.yaml"), "--yaml-aliases"]) == 0
