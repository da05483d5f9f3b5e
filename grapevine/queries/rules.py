"""Rule models: stand-ins for a remote model whose answers depend only on the text they get.

Each returns a response in the shape a model client gives, so that the whole call path runs; the SQL of a stage
states the same rule.
"""

from __future__ import annotations

import json

from ..fixed import TOPICS
from ..operators.infer import Caller

STRAY = [*TOPICS, "compatibility"]
LABELS = ["negative", "neutral", "positive"]


def _answer(body: dict, payload: str, fenced: bool = True) -> dict:
    text = json.dumps(body, ensure_ascii=False)
    if fenced:
        text = f"```json\n{text}\n```"
    blocks = [{"type": "thinking", "text": ""}, {"type": "text", "text": text}]
    return {"content": blocks, "tokens_in": len(payload), "tokens_out": len(text)}


def classify(payload: str) -> dict:
    """Everything follows from the length of the text; every thirteenth length is left out of the answer."""
    out = []
    for item in json.loads(payload):
        n = len(item["text"])
        if n % 13:
            out.append(
                {"id": item["id"], "sentiment": LABELS[n % 3], "topic": STRAY[n % 8], "confidence": n % 100 / 100,
                 "stars": n % 12 / 2}
            )
    return _answer({"classifications": [*out, {"id": "nobody", "sentiment": "neutral"}]}, payload)


def translate(payload: str) -> dict:
    out = [
        {"id": i["id"], "language": ["de", "es", "fr"][len(i["text"]) % 3], "english": "EN: " + i["text"]}
        for i in json.loads(payload)
        if len(i["text"]) % 13
    ]
    return _answer({"translations": out}, payload)


def issue(payload: str) -> dict:
    items = json.loads(payload)
    return _answer({"issues": [{"id": i["id"], "issue": f"issue {len(i['text']) % 7}"} for i in items if len(i["text"]) % 5]}, payload)


def assign(payload: str) -> dict:
    out = [
        {"id": i["id"], "issue": f"issue {len(i['text']) % 7}", "category": len(i["text"]) % 14 - 1}
        for i in json.loads(payload)
        if len(i["text"]) % 11
    ]
    return _answer({"assignments": out}, payload)


def name_clusters(payload: str) -> dict:
    items = json.loads(payload)
    return _answer(
        {"clusters": [{"id": i["id"], "label": f"group of {i['size']}", "topic": STRAY[i["size"] % 8]} for i in items]}, payload
    )


def reply(payload: str) -> dict:
    """Fails on every seventeenth length, the way a remote call fails."""
    item = json.loads(payload)
    if len(item["review"]) % 17 == 0:
        raise RuntimeError("model overloaded")
    text = f" Dear {item['customer_name']}: {item['playbook']} ({item['issue']}) "
    return _answer({"reply": text}, payload, fenced=False)


def judge(payload: str) -> dict:
    item = json.loads(payload)
    n = len(item["review"]) + len(item["reply"])
    body = {
        "empathy": 3 + n % 3, "specificity": 4 + n % 2, "correctness": 5 - n % 2, "tone": 5,
        "promises_outcome": n % 19 == 0, "invents_facts": n % 23 == 0, "wrong_language": False,
        "needs_human_attention": n % 10 == 0, "reason": f"length {n}",
    }
    return _answer(body, payload)


PRICES = {"rule-small": (1.0, 5.0), "rule-large": (2.0, 10.0)}


def caller(call_fn, model: str = "rule-small", **options) -> Caller:
    return Caller(call_fn, model, PRICES, wait_s=0.0, **options)
