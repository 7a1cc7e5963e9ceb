from sparkloom.api import Engine


def test_a_small_repository_end_to_end(spark, tmp_path):
    repo = tmp_path / "repo"
    for name, text in {
        "api/users.py": "from models.db import load\n\n@app.get('/users')\ndef users():\n    return load()\n",
        "models/db.py": "import api.users\n\nclass Db:\n    '''Holds rows.'''\n    def get(self):\n        return 1\n\ndef load():\n    d = Db()\n    return d.get()\n\ndef unused():\n    pass\n",
    }.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(text)
    e = Engine(spark, str(tmp_path / "db"), str(repo), model=lambda p: f"{len(p)} characters")
    assert e.index(embed=False)["entities"] == 7
    key = "py:models/db.py:load"
    assert {(r.callee, r.caller) for r in e.impact(key, 2).collect()} >= {(key, "py:api/users.py:users"), ("py:api/users.py:users", "route:GET /users")}
    assert [r.members for r in e.cycles().collect()] == [["api/users.py", "models/db.py"]]


def _state(e: Engine) -> tuple[set, set]:
    return {r.entity_id for r in e.entities.collect()}, {(r.src_id, r.dst_id, r.type) for r in e.edges.collect()}


def test_only_changed_files_are_parsed(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "a.py").write_text("from b import late\n\ndef go():\n    late()\n")
    (repo / "b.py").write_text("def early():\n    pass\n")
    (repo / "c.py").write_text("from b import early\n\ndef use():\n    early()\n")
    e = Engine(spark, str(tmp_path / "db"), str(repo))
    assert e.index(embed=False)["parsed"] == 3
    before = _state(e)
    warm = e.index(embed=False)
    assert (warm["changed"], warm["parsed"], warm["deleted"]) == (0, 0, 0) and _state(e) == before
    # a name that appears later resolves for files that are not parsed again
    (repo / "b.py").write_text("def early():\n    pass\n\ndef late():\n    pass\n")
    (repo / "c.py").write_text("def use():\n    pass\n")
    one = e.reindex(["b.py"], embed=False)
    assert (one["parsed"], one["deleted"]) == (1, 0)
    _, edges = _state(e)
    assert ("py:a.py:go", "py:b.py:late", "calls") in edges and ("py:c.py:use", "py:b.py:early", "calls") in edges
    assert e.index(embed=False)["parsed"] == 1  # c.py, left alone before
    (repo / "b.py").unlink()
    assert e.reindex(["b.py", "none.py"], embed=False)["deleted"] == 1
    # the same as a store made at once
    whole = Engine(spark, str(tmp_path / "other"), str(repo))
    whole.index(embed=False)
    assert _state(e) == _state(whole) and not any(x.startswith("py:b.py") for x in _state(e)[0])
