import json

import pytest

from proselake.plans.config import ConfigError, Loader, custom_text, folders, input_limit, read_file


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_layers(tmp_path):
    put(tmp_path / "home/proselake/config.toml", 'max_grade = 9\ndialect = "en-gb"\ntoken_budget = 10\n[templates]\nmemo = ["Aim"]\n')
    put(tmp_path / "project/.proselake.json", json.dumps({"max_grade": 10, "style_min_score": 50, "templates": {"note": ["Body"]}}))
    put(tmp_path / "project/proselake.yaml", "max_grade: 11\n")
    extra = put(tmp_path / "extra.conf", "passive_max_percent = 7")
    deep = tmp_path / "project/a/b"
    deep.mkdir(parents=True)
    env = {"XDG_CONFIG_HOME": str(tmp_path / "home"), "PROSELAKE_TOKEN_BUDGET": "77"}
    made = Loader(project=deep, files=[extra], environ=env)
    got = made.load()
    assert (got["max_grade"], got["style_min_score"], got["passive_max_percent"], got["dialect"], got["token_budget"]) == (11.0, 50, 7.0, "en-gb", 77)
    assert got["templates"] == {"memo": ["Aim"], "note": ["Body"]} and got["log_level"] == "info"
    assert [p.name for p in made.sources()] == ["config.toml", ".proselake.json", "proselake.yaml", "extra.conf"]
    assert Loader(project=deep, user=False, environ=env).load()["dialect"] is None


def test_search_ends_at_the_boundary(tmp_path):
    put(tmp_path / "proselake.toml", "max_grade = 5")
    (tmp_path / "repo/.git").mkdir(parents=True)
    (tmp_path / "repo/sub").mkdir()
    assert Loader(project=tmp_path / "repo/sub", user=False).project_files() == []
    # the first folder's own boundary does not end the search
    assert len(Loader(project=tmp_path / "repo", user=False).project_files()) == 1
    assert len(Loader(project=tmp_path / "repo/sub", user=False, boundary=None).project_files()) == 1
    with pytest.raises(ConfigError):
        Loader(project=tmp_path / "repo/sub", user=False).load_or_error()


@pytest.mark.parametrize(("name", "text"), [("a.toml", "x ="), ("a.json", "{"), ("a.json", "[1]"), ("a.yaml", "a: [")])
def test_broken_files(tmp_path, name, text):
    with pytest.raises(ConfigError):
        read_file(put(tmp_path / name, text))


def test_values(tmp_path):
    with pytest.raises(ConfigError):
        Loader(user=False, environ={"PROSELAKE_DIALECT": "fr"}).load()
    with pytest.raises(ConfigError):
        Loader(user=False, environ={"PROSELAKE_MAX_GRADE": "high"}).load()
    load = lambda **e: Loader(user=False, environ=e).load()
    assert input_limit(load(), 5) == 5 and input_limit(load(PROSELAKE_MAX_INPUT_BYTES="9"), 5) == 9
    assert input_limit(load(PROSELAKE_DISABLE_INPUT_LIMIT="true", PROSELAKE_MAX_INPUT_BYTES="9"), 5) is None


def test_custom_text(tmp_path):
    put(tmp_path / "voice.md", "plain words")
    assert custom_text({"file": "voice.md", "instructions": "x"}, tmp_path) == "plain words"
    assert custom_text({"instructions": "x"}, tmp_path) == "x"
    for broken in ({}, {"file": "none.md"}):
        with pytest.raises(ConfigError):
            custom_text(broken, tmp_path)


def test_folders():
    got = folders(environ={"HOME": "/h", "XDG_CACHE_HOME": "/c"})
    assert {k: str(v) for k, v in got.items()} == {"config": "/h/.config/proselake", "cache": "/c/proselake", "data": "/h/.local/share/proselake", "data_local": "/h/.local/share/proselake"}
    assert folders(environ={}) is None
