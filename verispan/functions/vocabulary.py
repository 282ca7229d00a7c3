"""Names of objects in text: categories with their aliases, singular forms, and captions' words mapped to object words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

# Plurals that no rule makes, and names of the young, by category.
IRREGULAR_ALIASES = {
    "people": "person", "men": "person", "man": "person", "women": "person", "woman": "person", "children": "person", "child": "person",
    "busses": "bus", "kittens": "cat", "puppies": "dog", "cattle": "cow", "purses": "handbag", "ski": "skis", "knives": "knife", "doughnuts": "donut",
    "houseplants": "potted plant", "televisions": "tv", "television": "tv", "mice": "mouse", "cellphones": "cell phone", "mobile phones": "cell phone",
    "smartphones": "cell phone", "fridges": "refrigerator", "hair dryers": "hair drier", "hair dryer": "hair drier",
}
# Synonyms, by category.
SYNONYM_ALIASES = {
    "sofa": "couch", "sofas": "couch", "aeroplane": "airplane", "aeroplanes": "airplane", "plane": "airplane", "planes": "airplane", "motorbike": "motorcycle",
    "motorbikes": "motorcycle", "bike": "bicycle", "cellphone": "cell phone", "mobile phone": "cell phone", "smartphone": "cell phone", "fridge": "refrigerator",
}
# Names that are their own plural.
NO_PLURAL = frozenset(("skis", "scissors", "sheep", "broccoli"))


def plural(name: str) -> str:
    """The regular plural of a name, by its last word."""
    if re.search(r"(?:s|x|z|ch|sh)$", name):
        return name + "es"
    if re.search(r"[^aeiou]y$", name):
        return name[:-1] + "ies"
    return name + "s"


def phrases(categories: Iterable[str]) -> dict[str, str]:
    """Every phrase that names a category: the name, its plural, and the aliases whose category is among them."""
    names = sorted({c.strip().lower() for c in categories if c and c.strip()})
    out = {n: n for n in names}
    for n in names:
        if n not in NO_PLURAL:
            out.setdefault(plural(n), n)
    for alias, n in {**IRREGULAR_ALIASES, **SYNONYM_ALIASES}.items():
        if n in names:
            out.setdefault(alias, n)
    return out


def match_order(phrase: str) -> tuple[int, int, str]:
    """Phrases of more words first, then longer ones, then by name."""
    return -len(phrase.split()), -len(phrase), phrase


# Irregular singulars of object words.
SINGULARS = {
    "people": "person", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "knives": "knife", "leaves": "leaf", "shelves": "shelf", "wolves": "wolf",
    "buses": "bus", "geese": "goose", "feet": "foot", "teeth": "tooth", "oxen": "ox", "skis": "ski", "ties": "tie", "glasses": "glass", "dishes": "dish", "benches": "bench",
    "boxes": "box", "sandwiches": "sandwich", "couches": "couch", "giraffes": "giraffe", "vases": "vase",
}
# Words that end in s and are no plurals.
NOT_PLURAL = frozenset("bus glass grass dress class bicycles sheep skis this is was has his its us gas lens boss chess".split())


def singular(word: str) -> str:
    """The singular of a lower-case word by table and endings; words of up to three letters stay."""
    if word in SINGULARS:
        return SINGULARS[word]
    if word in NOT_PLURAL or len(word) <= 3:
        return word
    for ending, keep, add in (("ies", 3, "y"), ("sses", 2, ""), ("ches", 2, ""), ("shes", 2, ""), ("xes", 2, ""), ("zes", 2, "")):
        if word.endswith(ending) and (ending != "ies" or len(word) > 4):
            return word[:-keep] + add
    return word[:-1] if re.search(r"[^sui]s$", word) else word


# Pairs of words that name one object.
DOUBLE_WORDS = (
    "motor bike", "motor cycle", "air plane", "traffic light", "street light", "traffic signal", "stop light", "fire hydrant", "stop sign", "parking meter", "suit case",
    "sports ball", "baseball bat", "baseball glove", "tennis racket", "wine glass", "hot dog", "cell phone", "mobile phone", "teddy bear", "hair drier", "potted plant",
    "bow tie", "laptop computer", "stove top oven", "home plate", "train track",
)
# Animals that "baby" and "adult" may stand before, and vehicles after "passenger".
ANIMALS = ("bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "animal", "cub")
VEHICLES = ("jet", "train")
# Pairs that are renamed.
RENAMED_PAIRS = {"bow tie": "tie", "toilet seat": "toilet", "wine glas": "wine glass"}

_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?|[^\sa-z]")


class ObjectWords:
    """Object words of captions: each line of synonyms has its object word first, separated by commas."""

    def __init__(self, lines: Iterable[str]) -> None:
        self.node: dict[str, str] = {}
        for line in lines:
            words = [w.strip() for w in line.split(",") if w.strip()]
            self.node.update({w: words[0] for w in words})
        self.pairs = {p: p for p in DOUBLE_WORDS} | {f"{a} {w}": w for w in ANIMALS for a in ("baby", "adult")} | {f"passenger {w}": w for w in VEHICLES} | RENAMED_PAIRS

    def tokens(self, text: str) -> list[tuple[str, int, int]]:
        """(singular word, start, end) of words and marks."""
        return [(singular(m.group()), m.start(), m.end()) for m in _TOKEN.finditer(_lower(text))]

    def mentions(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """(word, object word, start, end) in order; pairs of words count as one, and a seat is no object where a toilet is named."""
        rest, merged = self.tokens(text or ""), []
        at = 0
        while at < len(rest):
            pair = " ".join(t[0] for t in rest[at : at + 2])
            if pair in self.pairs and at + 1 < len(rest):
                merged.append((self.pairs[pair], rest[at][1], rest[at + 1][2]))
                at += 2
            else:
                merged.append(rest[at])
                at += 1
        skip = {"seat"} if any(t[0] == "toilet" for t in merged) else set()
        return [(w, self.node[w], a, b) for w, a, b in merged if w in self.node and w not in skip]


def _lower(text: str) -> str:
    """Lower case that keeps every position: a character whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


# Cues by which a mention does not claim that the object is there, as patterns.
NEGATED = r"\b(?:no|not|none|without|lacks?|never|zero|neither|nor)\b|\bcan(?:not|'t)\s+see\b|\bdo(?:es)?\s+not\s+(?:contain|see|have|show)\b|\bdo(?:es)n't\s+(?:contain|see|have|show)\b"
UNCERTAIN = r"\b(?:might|maybe|possibly|perhaps|could|may|unclear)\b|\bappears?\s+to\b|\bseems?\s+to\b|\bnot\s+sure\b|\bhard\s+to\s+tell\b"
HYPOTHETICAL = r"\b(?:if|would|suppose|assume|hypothetically)\b"
DEPICTED = r"\b(?:painting|drawing|sketch|statue|sculpture|poster|illustration)\s+of\b|\bphoto\s+of\s+a\s+picture\s+of\b|\bt-?shirt\s+with\b"
NOT_VISUAL = r"\bat\s+home\b|\bin\s+the\s+future\b|\bin\s+my\s+mind\b|\breminds\s+me\s+of\b|\bthought\s+of\b"
ASKED = r"^(?:is|are|do|can|could|what|where)\s+(?:there|you|we)"
PLACING = r"\b(?:on|in|under|behind|near|beside|inside|at|with|by|from|over|into)\b"
JOINED_NEGATION = r"\b(?:neither|nor|no|not)\s+[a-zA-Z\s,]+?\s+(?:or|nor)\s+(?:[a-zA-Z\s]+\s+)?$"
NEGATED_AFTER = r"^(?:\s+(?:is|are|was|were))?\s+(?:not\s+(?:visible|present|seen)|nowhere)"
VERB_BEFORE = r"\b(?:to|can|will|must|should|going\s+to)\s+$"
_CUES = {k: re.compile(v) for k, v in dict(negated=NEGATED, uncertain=UNCERTAIN, hypothetical=HYPOTHETICAL, depicted=DEPICTED, not_visual=NOT_VISUAL, asked=ASKED, placing=PLACING, joined=JOINED_NEGATION, after=NEGATED_AFTER, verb=VERB_BEFORE).items()}

_SENTENCE = re.compile(r"[^.!?]+[.!?]*")
_RUN = re.compile(r"\w+")
_SPAN = tuple[int, int, str]


def sentences(text: str | None) -> list[_SPAN]:
    """(start, end, sentence) without outer blanks; a text of end marks only is one sentence."""
    text = text or ""
    out = []
    for m in _SENTENCE.finditer(text):
        s = m.group().strip()
        if s:
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            out.append((at, at + len(s), s))
    return out or ([(0, len(text), text)] if text.strip() else [])


class MentionRules:
    """Mentions of categories in a text, each accepted or with the reason why it claims nothing."""

    def __init__(self, names: dict[str, str]) -> None:
        self.names = names
        self.by_first: dict[str, list[tuple[tuple[int, int, str], str]]] = {}
        for p in names:
            self.by_first.setdefault(_RUN.match(p).group(), []).append((match_order(p), p))

    def _found(self, low: str) -> list[tuple[int, int, str]]:
        """Matches at word boundaries; one that lies inside a match of an earlier phrase of the order does not count."""
        ends = {m.end() for m in _RUN.finditer(low)}
        hits = [(rank, m.start(), m.start() + len(p), p) for m in _RUN.finditer(low) for rank, p in self.by_first.get(m.group(), ()) if low.startswith(p, m.start()) and m.start() + len(p) in ends]
        kept: list[tuple[int, int, str]] = []
        for _, a, b, p in sorted(hits):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, p))
        return sorted(kept)

    def _reason(self, low: str, a: int, b: int, category: str, question: bool) -> str | None:
        before, after = low[:a], low[b:]
        placed = [m.start() for m in _CUES["placing"].finditer(before)]
        near = before[placed[-1] :] if placed else before
        if question:
            return "question"
        if _CUES["hypothetical"].search(before):
            return "hypothetical"
        if _CUES["uncertain"].search(near):
            return "uncertain"
        if _CUES["negated"].search(" ".join(near.split()[-10:])) or (not placed and _CUES["joined"].search(before)) or _CUES["after"].search(after):
            return "negated"
        if _CUES["depicted"].search(before):
            return "depiction"
        if _CUES["not_visual"].search(low):
            return "non_visual"
        following = after.split()
        if category == "orange" and following and following[0].strip(",.!?") in self.names:
            return "ambiguous_sense"
        if category == "train" and _CUES["verb"].search(before):
            return "ambiguous_sense"
        return None

    def __call__(self, text: str | None) -> list[tuple[int, int, str, int, str, str, str | None]]:
        """(start, end, surface, sentence number, sentence, category, reason or None)."""
        out = []
        for k, (at, _, s) in enumerate(sentences(text)):
            low = _lower(s)
            question = s.endswith("?") or bool(_CUES["asked"].search(low))
            for a, b, p in self._found(low):
                out.append((at + a, at + b, s[a:b], k, s, self.names[p], self._reason(low, a, b, self.names[p], question)))
        return out


def minimal_context(caption: str | None, surface: str | None, most_words: int = 15, around: int = 4) -> str | None:
    """The sentence that holds the surface form, cut to ``around`` words on each side where it is long; the caption's beginning where none does."""
    if not caption or not surface:
        return None
    want = surface.lower().split()
    for s in re.split(r"(?<=[.!?])\s+", caption):
        if surface.lower() not in s.lower():
            continue
        words = s.split()
        low = [w.lower() for w in words]
        at = next((i for i in range(len(low) - len(want) + 1) if low[i : i + len(want)] == want), None)
        if len(words) <= most_words or at is None:
            return s.strip()
        lo, hi = max(0, at - around), min(len(words), at + len(want) + around)
        return ("..." if lo else "") + " ".join(words[lo:hi]) + ("..." if hi < len(words) else "")
    words = caption.split()
    return caption.strip() if len(words) <= most_words else " ".join(words[:most_words]) + "..."


def span_features(spans: Sequence[tuple[int, int]], logprobs: Sequence[float], start: int, end: int) -> tuple[float, float, float] | None:
    """(mean, first, least) log-probability of the tokens that overlap [start, end); None without any."""
    own = [p for (a, b), p in zip(spans, logprobs) if b > start and a < end]
    return (sum(own) / len(own), own[0], min(own)) if own else None
