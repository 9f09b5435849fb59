"""A decoder of the tests: a document is a JSON list of pages, each a list of lines. It notes what it decodes."""

import json


def page_spans(content, wanted):
    for page, lines in enumerate(json.loads(content), 1):
        if wanted(page):
            for n, text in enumerate(lines):
                yield {"page": page, "block": n, "line": 0, "span": 0, "text": f"{text}", "size": 9.0, "flags": 0, "font": "Serif", "x0": 0.0, "y0": 10.0 * n, "x1": 90.0, "y1": 10.0 * n + 9}
        elif wanted(-1):
            raise AssertionError("no such page")
