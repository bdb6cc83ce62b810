from tracewright.llm import hashed


def test_shape_of_a_whole_token():
    long = "aB3" * 40
    assert hashed._shape(long + "x") != hashed._shape(long + "!")
    assert hashed._shape("a" * 200) == hashed._shape("a" * 90)
    whole, other = (dict(zip(*(x.tolist() for x in hashed.style_of(long + end)))) for end in ("x", "!"))
    assert whole != other
