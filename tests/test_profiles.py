import pytest

from docloom.plans import profiles


@pytest.mark.parametrize("name", profiles.PROFILES)
def test_every_profile_builds_with_all_answers(name):
    p = profiles.build(name, **dict.fromkeys(profiles.ANSWERS, True))
    base = profiles.PROFILES[name]
    assert p.chunking().chunk_size == round(base.chunk_size * 1.5) and p.search().top_k == base.top_k + 10
    assert p.rerank and p.alpha >= 0.1 and p.temperature <= 0.1 and p.citations == "footnote"
    assert profiles.build(name) == base and profiles.summary(base)["retrieval"] == base.architecture


def test_unknown_answers_are_refused():
    with pytest.raises(ValueError):
        profiles.build("general", q9=True)


def test_export_strips_secrets_and_merges():
    text = profiles.export_config({"profile": "general", "llm": {"api_key": "x", "model": "m"}, "embedding": None}, "2024-01-01")
    assert '"x"' not in text
    assert profiles.import_config(text)["llm"] == {"model": "m"}
    merged = profiles.import_config(text, {"llm": {"api_key": "own", "model": "old"}, "embedding": {"a": 1}})
    assert merged["llm"] == {"api_key": "own", "model": "m"} and merged["embedding"] == {"a": 1}
    with pytest.raises(ValueError):
        profiles.import_config("{}")
