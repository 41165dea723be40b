"""Notices inside long lines, and wrapped word by word."""

from loglantern.llm import licenses


def test_notices_wherever_lines_break():
    t = licenses.Templates(licenses.TEMPLATES, 0.8)
    found = lambda text: [(a, b, k, round(s, 3)) for a, b, k, s in t.find(text)]
    assert found("/*! lib v3.6.0 | Released under the MIT License. */") == [(0, 0, "MIT", 1.0)]
    filler = " ".join(f"word{i}" for i in range(300))
    notice = licenses.TEMPLATES["GPL-long"]
    assert found(f"{filler} {notice} {filler} released under the MIT license {filler}") == [(0, 0, "GPL-long", 1.0), (0, 0, "MIT", 1.0)]
    assert found("x\n" + notice.replace(" ", "\n") + "\ny") == [(1, len(notice.split()), "GPL-long", 1.0)]
    assert found("a\nb c d\nMIT\nLicense\nof the e") == []
    assert licenses.Templates({"one": "zlib"}, 0.8).find("a zlib\nb") == [(0, 0, "one", 1.0)]
