import pytest

from trailmark.operators import options


def test_names_that_are_typed(spark):
    rows = [("p1", ["Sampler Server", "acme/sampler"]), ("p2", ["Sampler Web"]), ("p3", ["web"]), ("p4", ["Zed"]), ("p5", None)] + [(f"q{i}", [f"Other {i}"]) for i in range(9)]
    df = spark.createDataFrame(rows, "value string, names array<string>")
    ask = lambda typed: options.resolve(df, "--project", typed)
    assert ask("WEB ") == "p3" and ask("acme") == "p1" and ask("sampler server") == "p1" and ask("zE") == "p4"
    one = "01234567-89ab-cdef-0123-456789abcdef"
    assert ask(one) == one
    with pytest.raises(options.OptionError, match="--project sampler matches more than one: Sampler Server, Sampler Web. Use"):
        ask("sampler")
    with pytest.raises(options.OptionError, match="matches more than one: Other 0, .*Other 7 and more. Use"):
        ask("other")
    with pytest.raises(options.OptionError, match=r"sampelr matched nothing. Known values: Sampler Server, Sampler Web, .* and 6 more\.$"):
        ask("sampelr")
