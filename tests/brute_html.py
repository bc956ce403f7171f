"""Row-at-a-time page facts on Python's own HTML parser, to check the Spark expressions."""

from html.parser import HTMLParser


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", "", data))


def _forms(events):
    stack, found = [], False
    for kind, tag, attrs in events:
        if tag == "form" and kind == "open":
            stack.append(-100 if attrs.get("role", "").lower() == "search" else 0)
        elif tag == "form" and stack:
            stack.pop()
        elif kind == "open" and tag in ("input", "select", "textarea") and stack:
            usual = attrs.get("type", "").lower() or "text"
            if tag == "input" and usual in {
                "hidden", "submit", "button", "search", "image", "reset"
            }:
                continue
            stack[-1] += 1
            found = found or tag == "textarea" or stack[-1] >= 2
    return found


def facts(text):
    parser = _Events()
    parser.feed(text)
    events = parser.events
    opened = [(t, a) for k, t, a in events if k == "open"]
    metas = [a for t, a in opened if t == "meta"]
    descriptions = [m.get("content", "") for m in metas if m.get("name", "").lower() == "description"]
    titles, in_title, skip, chars = [], False, 0, 0
    anchors, link, words, blobs, in_json = [], None, [], [], False
    for kind, tag, value in events:
        if kind == "text":
            chars += 0 if skip else len(value.strip())
            titles += [value] if in_title else []
            blobs += [value] if in_json else []
            words += [value]
            continue
        opens = kind == "open"
        if tag in ("script", "style", "noscript"):
            skip = skip + 1 if opens else max(skip - 1, 0)
        if tag == "title":
            in_title = opens
        if tag == "script":
            in_json = opens and value.get("type", "").lower() == "application/ld+json"
        if tag == "a" and opens and value.get("href"):
            link, words = value["href"], []
        elif tag == "a" and not opens and link is not None:
            anchors.append((link, " ".join("".join(words).split())))
            link = None
    return {
        "title": "".join(titles).strip(),
        "meta_description": descriptions[-1].strip() if descriptions else "",
        "has_viewport": any(m.get("name", "").lower() == "viewport" for m in metas),
        "lang": ([a.get("lang", "").lower() for t, a in opened if t == "html"] or [""])[-1],
        "visible_chars": chars,
        "links": [a["href"] for t, a in opened if t == "a" and a.get("href")],
        "anchors": anchors,
        "ldjson_blobs": blobs,
        "has_form": _forms(events),
    }
