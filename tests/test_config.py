import pytest

from folioweave import config as C


def test_layers_hash_and_round_trip():
    c = C.resolve("[typography]\nsize_class_depth = 2\n", {"markdown": {"max_words": 500}}, ("typography.size_class_depth=3", "processing.markdown_content_mode=inclusive"))
    assert (c.typography.size_class_depth, c.markdown.max_words, c.markdown_content_mode) == (3, 500, "inclusive")
    assert C.config_hash(c) == C.config_hash(C.resolve(C.to_toml(c))) != C.config_hash(C.ProcessingConfig())
    assert C.schema()["properties"]["typography"]["properties"]["margin_band_ratio"] == {"type": "number", "default": 0.12, "exclusiveMinimum": 0, "maximum": 0.25}


@pytest.mark.parametrize("text", ["typography.size_clas_depth=1", "typography.size_class_depth=-1", "typography.size_class_depth=true", "typography.heading_candidate_mode=other", "markdown.enabled=1"])
def test_wrong_settings_are_refused(text):
    with pytest.raises(C.ConfigError):
        C.resolve(overrides=(text,))
