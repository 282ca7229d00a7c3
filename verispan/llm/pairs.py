"""Broken prompt and response pairs.

Rules on one pair tell empty, copied, refused and wrong-language answers. A cut
answer is told by three things gathered over all answers:

* neighbours: the answers are sorted by text; an answer that begins its
  successor is a shortened version, and what follows in the longer one tells
  whether it stops inside a word or sentence;
* ends: how often each last word, after the word before it, ends a sentence in
  finished answers;
* length limits: lengths in tokens at which unfinished answers pile up, per limit.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispan.llm.lookalike import hidden
from verispan.llm.words import RANKS, tokenizer
from verispan.session import cut

# Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the a an is are of in on and to with at by near under behind there it yes no this that only one from not sits stands shows",
    "de": "der die das ein eine einen einem und ist sind nicht mit auf im in dem den neben vor unter ja nein zu während steht liegt",
    "fr": "que ce qui le la les un une des et est sont dans sur du de au près devant sous oui non pas se avec cette tandis il",
    "es": "el la los las un una y es está en del de al junto detrás delante bajo sí no con que mientras hay sobre lo",
    "it": "di che il lo la gli un una e è nella nel del di della accanto davanti dietro sotto sì non con mentre sul si tra",
    "pt": "o a os as um uma e é na no do da ao perto atrás sob sim não com que enquanto em está há sobre",
    "nl": "de het een en is zijn van in op met naast voor onder achter ja nee niet terwijl staat ligt bij er te",
    "ru": "и в на не с у за под перед рядом это да нет стоит лежит из по к от около",
}
FUNCTION_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

# Words of requests, which are short of function words.
REQUEST_WORDS = {
    "en": "image picture photo caption describe description detailed detail what which where how many can see tell write give provide please list show scene",
    "de": "bild foto beschreibe beschreiben beschreibung was wie wo viele welche zeigt bitte kurz schreibe",
    "fr": "photo image décris décrire décrivez quoi où combien quel quelle montre voit brièvement écris",
    "es": "imagen foto describe explica qué cuántos dónde cuál muestra ve esta este por favor brevemente escribe",
    "it": "immagine foto descrivi cosa dove quanti quale mostra questa brevemente scrivi vede",
    "pt": "imagem foto descreva onde quantos qual mostra esta brevemente escreva vê favor",
    "nl": "afbeelding foto beschrijf wat waar hoeveel welke toont deze kort schrijf",
    "ru": "фото изображение опиши что где сколько какой видно кратко напиши картинке",
}
REQUEST_WORDS = {k: frozenset(v.split()) | FUNCTION_WORDS[k] for k, v in REQUEST_WORDS.items()}

# Names of languages.
LANGUAGE_NAMES = {
    "english": "en", "englisch": "en", "englischer": "en", "anglais": "en", "inglés": "en", "inglese": "en", "английском": "en",
    "german": "de", "deutsch": "de", "deutscher": "de", "allemand": "de", "alemán": "de", "tedesco": "de", "немецком": "de",
    "french": "fr", "französisch": "fr", "französischer": "fr", "français": "fr", "francés": "fr", "francese": "fr", "французском": "fr",
    "spanish": "es", "spanisch": "es", "spanischer": "es", "espagnol": "es", "español": "es", "spagnolo": "es", "испанском": "es",
    "italian": "it", "italienisch": "it", "italienischer": "it", "italien": "it", "italiano": "it", "итальянском": "it",
    "portuguese": "pt", "portugiesisch": "pt", "portugais": "pt", "portugués": "pt", "português": "pt",
    "dutch": "nl", "niederländisch": "nl", "néerlandais": "nl", "neerlandés": "nl",
    "russian": "ru", "russisch": "ru", "russe": "ru", "ruso": "ru", "russo": "ru", "русском": "ru",
}
_NAMES = "|".join(sorted(LANGUAGE_NAMES, key=len, reverse=True))
_ASKS = re.compile(rf"\b(?:in|into|auf|en|em|на)\s+(?:the\s+)?({_NAMES})\b|\b({_NAMES})\s+(?:language\s+)?(?:caption|description|answer|sentence|text|translation|response|version|reply|words)\b")

# What stands in place of an answer.
PLACEHOLDERS = frozenset((
    "null", "nil", "nan", "na", "n a", "empty", "blank", "no answer", "no response", "no caption", "no output", "no text", "no data", "no description", "not available",
    "not applicable", "missing", "undefined", "placeholder", "tbd", "todo", "lorem ipsum", "answer here", "your answer", "insert answer", "insert caption here", "caption", "answer", "unk", "eos", "pad", "endoftext",
))

# Labels put before a repeated prompt.
_LABEL = re.compile(r"(?i)(?:^|(?<=[\s\"'>*#\]]))(?:user|assistant|human|system|question|q|a|answer|prompt|task|instruction|you asked|you said|input|output|request|caption|response|query|frage|antwort|pregunta|respuesta|réponse|domanda|risposta)\s*:")

_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

_PICTURE = r"(?:images?|pictures?|photos?|photographs?|files?|contents?|requests?|questions?|screenshots?|attachments?|visuals?|scene|this|that|it|you|these|those)"
_DO = r"(?:help|assist|comply|describe|discuss|comment|answer|respond|reply|view|look|see|process|analy[sz]e|interpret|provide|fulfil+|share|talk|identify|say|do|continue|open|access|caption|complete|proceed|give|make)"
_NOT = r"(?:can(?:not|\s?not|['’]?t)|could(?:\s?not|n['’]?t)|won['’]?t|will\s+not|(?:am|are|['’]m|['’]re)\s+(?:not\s+(?:able|allowed|permitted|authori[sz]ed|in\s+a\s+position)|unable|unwilling)(?:\s+to)?|may\s+not|must\s+not|(?:would|['’]d)\s+rather\s+not|do(?:\s+not|n['’]t)\s+(?:want|wish|feel\s+able)\s+to|refuse\s+to|decline\s+to)"
REFUSALS = [re.compile(x, re.I) for x in (
    # Ways to decline, by language.
    rf"\b(?:i|we)\s*{_NOT}\s+(?:\w+\s+){{0,2}}?{_DO}\b[^.!?]*\b{_PICTURE}\b",
    rf"\b(?:i|we)\s*{_NOT}\s+(?:help|assist|comply|fulfil+|answer|continue|comment|discuss|proceed|do\s+(?:that|this))\b",
    r"\b(?:i|we)\s+(?:have|need)\s+to\s+(?:decline|refuse|pass)|\b(?:i|we)\s+must\s+(?:decline|refuse)|\b(?:i|we)\s+(?:respectfully\s+)?(?:decline|refuse)\b",
    r"\b(?:do\s+not|don['’]t|lack|without)\s+(?:have\s+)?(?:the\s+)?(?:permission|ability|capability|access|authori[sz]ation)\b|\b(?:have|with)\s+no\s+(?:permission|ability|access|means|way|authori[sz]ation)\b|\b(?:i|we)\s*(?:would|['’]d)\s+(?:first\s+)?need\s+(?:to\s+see|access)\b",
    rf"\b(?:it\s+is|it['’]s)\s+(?:not\s+possible|impossible)\s+for\s+me\b|\bnot\s+possible\s+(?:for\s+me\s+)?to\s+{_DO}\b",
    rf"^\W*(?:(?:i['’]?m\s+)?sorry\W+|apologies\W+|regrettably\W+|unfortunately\W+)?(?:but\s+)?unable\s+to\s+{_DO}\b",
    r"\b(?:request|content|response|answer|caption|output|description|reply|query|prompt|message|image)\s+(?:(?:has|have)\s+been\s+|was\s+|were\s+|is\s+|are\s+)?(?:declined|denied|refused|rejected|withheld|blocked|filtered|removed|redacted|censored)\b",
    r"\b(?:content|request|image|picture|photo)\s+(?:can(?:not|\s?not|['’]?t)|could\s?n[o'’]t|may\s+not|must\s+not)\s+be\s+(?:processed|described|shown|discussed|answered|analy[sz]ed|fulfil+ed|completed|displayed)\b",
    r"\b(?:outside|beyond|against)\s+(?:of\s+)?(?:what\s+i|my\s+(?:scope|abilities|capabilities|guidelines|policy|policies|instructions|rules)|the\s+(?:policy|guidelines|rules))|\bviolates?\s+(?:the|my|our)\s+(?:policy|policies|guidelines|rules)",
    r"\b(?:do|does|did|will|would|may|can)(?:\s?not|n['’]?t)\s+(?:allow|permit|let|enable)\s+(?:me|us)\b|\b(?:prevents?|forbids?|keeps?)\s+(?:me|us)\s+from\b",
    r"\bno\s+(?:description|answer|caption|comment|response|help|information|details?|reply)\s+(?:can|could|may|will|shall)\s+be\s+\w+",
    r"\b(?:i|we)\s*(?:['’]ll|['’]d|\s(?:must|will|would|shall|should|have\s+to|need\s+to|prefer\s+to|want\s+to))\s+(?:pass|abstain|refrain|skip|opt\s+out|stop\s+here|not\s+(?:answer|describe|comment|discuss))\b|\b(?:i|we)\s+(?:would\s+)?prefer\s+not\s+to\b",
    rf"\b(?:i|we)\s*(?:am|are|['’]m|['’]re)\s+(?:not|un)\s*(?:able|allowed|permitted|authori[sz]ed)\b|\bnot\s+(?:something|anything)\s+(?:that\s+)?(?:i|we)\s+(?:can|may)\b|\bby\s+me\b[^.!?]*\b{_PICTURE}\b",
    # an apology that goes on in the first person, or about the request
    r"^\W*(?:(?:i\s*['’]?\s*a?m\s+(?:very\s+|so\s+)?(?:sorry|afraid)|we\s+are\s+sorry|sorry|apologies|my\s+apologies|i\s+apologi[sz]e|unfortunately|regrettably|i\s+regret)\b(?!\s+to\s+say)[^.!?]*\b(?:i|me|my|we|us|our|request|policy|policies|guidelines)\b)",
    r"(?i)\b(?:please\s+try\s+(?:another|a\s+different)|thank\s+you\s+for\s+(?:your\s+)?understanding|something\s+else\s+(?:i\s+can|you\s+would|you['’]d)|as\s+i\s+only\s+work\s+with\s+text)\b",
    r"^\W*(?:es\s+tut\s+mir\s+(?:sehr\s+)?leid|leider|ich\s+bedaure|entschuldigung)\b[^.!?]*\b(?:ich|mir|mich|anfrage|bitte)\b|^\W*(?:désolée?|je\s+suis\s+désolée?|je\s+regrette|malheureusement)\b[^.!?]*\b(?:je|j|me|m|demande)\b",
    r"^\W*(?:lo\s+siento|lamentablemente|lamento|disculpe|mi\s+dispiace|purtroppo|desculpe|lamento|infelizmente)\b[^.!?]*\b(?:me|mi|puedo|posso|petición|solicitud|richiesta|pedido)\b|^\W*(?:извините|простите|к\s+сожалению)\b[^.!?]*(?:\bя\b|\bмне\b|запрос)",
    r"\bas\s+an?\s+(?:ai|language|text)\b[^.!?]*\b(?:can(?:not|['’]?t)|unable|not\s+able|don['’]t|do\s+not)\b",
    r"\b(?:ich|wir)\s+(?:kann|darf|können|dürfen|möchte)\b[^.!?]*\bnicht\b|\bkann\s+ich\b[^.!?]*\bnicht\b|\bnicht\s+möglich\b|\b(?:ist\s+mir|bin\s+ich)\s+(?:leider\s+)?nicht\s+(?:möglich|in\s+der\s+lage)|\bich\s+bin\s+nicht\s+in\s+der\s+lage\b|\bich\s+muss\b[^.!?]*\bablehnen\b",
    r"\bje\s+(?:ne\s+(?:peux|puis|suis|dois)|refuse)\b|\bil\s+m['’]est\s+impossible\b|\bil\s+ne\s+m['’]est\s+pas\s+possible\b|\bje\s+dois\s+(?:refuser|décliner)\b",
    r"\bno\s+(?:puedo|podemos|me\s+es\s+posible|estoy\s+(?:autorizad|en\s+condiciones)|tengo\s+permiso)|\bdebo\s+(?:rechazar|declinar)\b|\bme\s+niego\b",
    r"\bnon\s+(?:posso|sono\s+in\s+grado|mi\s+è\s+possibile)\b|\bdevo\s+(?:rifiutare|declinare)\b|\bnão\s+(?:posso|consigo|me\s+é\s+possível)\b|\bik\s+kan\b[^.!?]*\bniet\s+(?:helpen|beschrijven|bekijken|beantwoorden)\b",
    r"(?:^|\s)я\s+не\s+(?:могу|умею|буду)\b|(?:^|\s)не\s+могу\s+(?:помочь|описать|ответить|увидеть|обсуждать)|невозможно\s+(?:описать|ответить|помочь)",
)]
#: An answer that goes on to tell what is seen is no refusal.
_TELLS = re.compile(r"(?i)\b(?:only|just|except|apart\s+from)\s+(?:the|a|an|one|some|two|three)\b")

_ENDS = frozenset(".!?。！？؟")
_CLOSERS = "\"'”’»)]}*_`"


def _words(t: str) -> list[str]:
    return _WORD.findall(t.lower())


_CYRILLIC = re.compile("[Ѐ-ӿ]")


def _by_word(lists: dict[str, frozenset]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for k, v in lists.items():
        if k != "ru":
            for w in v:
                out[w] = (*out.get(w, ()), k)
    return out


_FUNCTION_OF, _REQUEST_OF = _by_word(FUNCTION_WORDS), _by_word(REQUEST_WORDS)


def language(text: str, request: bool = False, words: list[str] | None = None) -> tuple[str | None, Counter]:
    """The language with clearly most function words (quoted text left out), or None; and the counts.

    request also counts the words typical of requests. words may give the words of a text without quotes.
    """
    if words is None or _QUOTED.search(text):
        words = _words(_QUOTED.sub(" ", text))
    if not words:
        return None, Counter()
    if _CYRILLIC.search(text):
        letters = [c for w in words for c in w if c.isalpha()]
        if letters and sum("Ѐ" <= c <= "ӿ" for c in letters) > len(letters) / 2:
            return "ru", Counter(ru=len(words))
    of = _REQUEST_OF if request else _FUNCTION_OF
    score: Counter = Counter()
    for w in words:
        for k in of.get(w, ()):
            score[k] += 1
    top = score.most_common(2)
    if not top or len(top) > 1 and top[0][1] == top[1][1]:
        return None, score
    return top[0][0], score


_LONGEST = max(len(x.split()) for x in PLACEHOLDERS)


def _shown(t: str) -> str:
    return t if t.isascii() else "".join(c for c in t if not hidden(c))


def is_empty(caption: str | None) -> bool:
    """Null, blank, or markup, punctuation or a placeholder in place of an answer."""
    if caption is None:
        return True
    if "<" not in caption and len(_words(_shown(caption[:400]))) > _LONGEST + 1:  # the last may be cut
        return False
    words = _words(re.sub(r"<[^<>]*>", " ", _shown(caption)))
    if not words:
        return True
    return " ".join(words) in PLACEHOLDERS


_LABEL_WORDS = frozenset("user assistant human system question q a answer prompt task instruction you asked said input output request caption response query frage antwort pregunta respuesta réponse domanda risposta".split())


def is_copied(prompt: str, caption: str, words: list[str] | None = None) -> bool:
    """Only repeats the prompt, however often: nothing but its words in order, a few dropped, changed or repeated, and labels."""
    p = _words(prompt)
    own = set(p)
    w = words if words is not None else _words(caption)
    # a turn below has at least as many words of the prompt as others
    if not p or 2 * sum(x not in own and x not in _LABEL_WORDS for x in w) > len(w):
        return False
    c = _words(_LABEL.sub(" ", caption))
    if not c or 2 * len(own & set(c)) < len(own):
        return False
    if len(p) == 1:
        return own == set(c)
    at = 0
    while at < len(c):
        m = difflib.SequenceMatcher(None, p, c[at : at + len(p) + 2], autojunk=False)
        blocks = [b for b in m.get_matching_blocks() if b.size]
        if not blocks:
            break
        same = sum(b.size for b in blocks)
        end = blocks[-1].b + blocks[-1].size
        left = len(c) - at
        slips = (end - same) + (1 if end < left and end == left - 1 and blocks[-1].a + blocks[-1].size < len(p) else 0)
        if same < 0.7 * len(p) and not (len(p) <= 4 and same >= len(p) - 1):
            break
        if slips > max(1, len(p) // 6):
            break
        # a question turned into a statement answers it: its verb has moved behind the next word
        if not at and c[0] == p[1] and p[0] in c[1 : len(p)]:
            break
        at += end + (slips - (end - same))
    return at >= len(c)


# One of these words, or parts of words around an apostrophe, is in every way to decline.
_DECLINING = frozenset((
    "i we me my us our t n cannot couldnot cant unable able not impossible possible sorry apologies unfortunately regrettably decline declined denied refused refuse rejected "
    "withheld blocked filtered removed redacted censored request requests policy policies guidelines rules permission ability capability access lack without allow permit enable prevents forbids ai understanding another different something "
    "content description caption answer response information help detail details reply output query prompt message "
    "nicht möglich leid leider bedaure entschuldigung ablehnen je peux puis désolé désolée regrette malheureusement il refuser décliner no puedo podemos posible debo niego siento lamentablemente lamento disculpe "
    "non posso devo dispiace purtroppo não consigo desculpe infelizmente ik я не могу невозможно извините простите сожалению"
).split())
# the rules also take a pronoun without a space before what follows
_DECLINING |= {p + w for p in ("i", "we") for w in "can cannot cant could couldnt won wont will am are may must would do dont refuse decline".split()}


# Words of a sentence about the request or the one who answers, which is no answer yet.
_ASIDE = frozenset((
    "i we me my us our you your request requests question asks asked prompt task instruction instructions sorry apologies thank thanks please policy policies guidelines ai assistant "
    "ich mir mich wir sie anfrage frage bitte danke je moi nous vous demande question merci yo nosotros usted petición solicitud pregunta gracias io richiesta domanda grazie eu pedido ik u vraag я мы вы запрос вопрос"
).split())


def _answers(sentence: str, asked: frozenset[str]) -> bool:
    """A statement about something else than the request, which it does not restate either."""
    w = _words(sentence)
    return len(w) >= 4 and not sentence.rstrip(_CLOSERS).endswith("?") and _ASIDE.isdisjoint(_apart(w)) and sum(x in asked for x in w) < 0.7 * len(w)


def _apart(words: list[str]) -> list[str]:
    """The words, and the parts of those with an apostrophe."""
    return [*words, *(x for w in words if "'" in w or "’" in w for x in w.replace("’", "'").split("'"))]


def _may_decline(words: list[str]) -> bool:
    return not _DECLINING.isdisjoint(_apart(words))


def is_refusal(caption: str, words: list[str] | None = None, prompt: str = "") -> bool:
    """Declines to answer, or says the picture cannot be seen or discussed; quoted text does not count.

    Every sentence is searched. Where a sentence that answers comes first, only the opening of
    the text can decline: an answer that adds what it cannot tell is one.
    """
    if not _may_decline(words if words is not None else _words(caption)):
        return False
    sentences = re.split(r"(?<=[.!?])\s+", _QUOTED.sub(" ", caption).strip())
    opening = len(" ".join(sentences[:3]))
    asked = frozenset(_words(prompt)) if prompt else frozenset()
    answered, at = False, 0
    for i, t in enumerate(sentences):
        if _may_decline(_words(t)):
            for m in (m for r in REFUSALS for m in r.finditer(t)):
                opens = at + m.start() < 120 or (opening < 200 and i < 3)
                if (opens or not answered) and (not _TELLS.search(t[m.start() :]) or re.search(r"(?i)\bonly\s+(?:work|able)", " ".join([t[m.start() :], *sentences[i + 1 :]]))):
                    return True
        answered = answered or _answers(t, asked)
        if answered and at > 120 and i >= 3:
            break
        at += len(t) + 1
    return False


@lru_cache(maxsize=1 << 16)
def wanted_language(prompt: str) -> str | None:
    """The language the prompt names, else its own."""
    named = _ASKS.search(prompt.lower())
    return LANGUAGE_NAMES[next(g for g in named.groups() if g)] if named else language(prompt, True)[0]


def wrong_language(prompt: str, caption: str, words: list[str] | None = None) -> bool:
    """Clearly in another language than the prompt names, else than the prompt's own."""
    want = wanted_language(prompt) if prompt else None
    if want is None:
        return False
    got, score = language(caption, words=words)
    if got is None or got == want:
        return False
    n = len(_words(_QUOTED.sub(" ", caption)))
    return score[got] >= max(1, min(2, n // 3)) and score[got] > 1.5 * score[want]


def unfinished(caption: str, words: list[str] | None = None) -> tuple[bool, bool, str, str, str]:
    """(open, sure, text, word before the last, last word) of an answer that has content.

    open: no sentence end. sure: it shows by itself that it was cut, by a comma
    or opening mark at its end, a mark of omission, or an unclosed quote or bracket.
    """
    t = caption.rstrip()
    while t and hidden(t[-1]):
        t = t[:-1].rstrip()
    cut_mark = t.endswith("…") or (t.endswith("...") and len(t) > 3)
    key = t.rstrip("….").rstrip() if cut_mark else t
    body = key.rstrip(_CLOSERS)
    whole = not cut_mark and bool(body) and body[-1] in _ENDS
    unclosed = key.count('"') % 2 == 1 or key.count("“") > key.count("”") or key.count("(") > key.count(")") or key.count("«") > key.count("»")
    sure = bool(key) and (key[-1] in ",;:(/&" or unclosed)
    w = _words(key) if words is None else words
    return (not whole) or (unclosed and not whole), sure and not whole, key, w[-2] if len(w) > 1 else "", w[-1] if w else ""


_ROWS = pa.schema([("response_id", pa.string()), ("defect", pa.string()), ("open", pa.bool_()), ("sure", pa.bool_()), ("marked", pa.bool_()), ("key", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("n_words", pa.int32()), ("length", pa.int32()), ("tokens", pa.int32()), ("limit", pa.int32())])
ROWS = "response_id string, defect string, open boolean, sure boolean, marked boolean, key string, w1 string, w2 string, n_words int, length int, tokens int, limit int"


def _judge(batches: Iterator[pa.RecordBatch], tokenizer_file: str = RANKS) -> Iterator[pa.RecordBatch]:
    """The rules on each pair, and what the cut rules need: tokens are counted for answers without an end, which alone are held against limits."""
    count = lambda t: len(tokenizer(tokenizer_file).encode_ordinary(t))
    for b in batches:
        out = []
        for i, p, c, limit in zip(*(b.column(k).to_pylist() for k in range(4))):
            p = p or ""
            if is_empty(c):
                out.append((i, "empty", False, False, False, None, "", "", 0, 0, 0, limit))
                continue
            words = _words(c)
            kind = "copied" if is_copied(p, c, words) else "refusal" if is_refusal(c, words, p) else "language" if wrong_language(p, c, words) else None
            o, sure, key, w1, w2 = unfinished(c, words)
            out.append((i, kind, o, sure, key != c.rstrip(), key, w1, w2, len(words), len(key), count(key) if o and kind is None else 0, limit))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_ROWS), _ROWS)], schema=_ROWS)


_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;](?=\s|$)")
_STOPS = frozenset(".!?;")


def _end_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often word pairs end a sentence or stand inside one, in finished answers; summed per task, sent on in portions."""
    end: Counter = Counter()
    seen: Counter = Counter()

    def rows():
        keys = [k for k in seen if k[1] not in _STOPS]
        first = ["" if k[0] in _STOPS else k[0] for k in keys]
        e = [end[k] for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(e, pa.int64()), pa.array([seen[k] - n for k, n in zip(keys, e)], pa.int64())], names=["w1", "w2", "e", "m"])

    for b in batches:
        for t in b.column(0).to_pylist():
            w = [".", *_TOKEN.findall(t.lower())]
            seen.update(zip(w, w[1:]))
            end.update((w[i - 2], w[i - 1]) for i in range(2, len(w)) if w[i] in _STOPS)
        if len(seen) > 200_000:
            yield rows()
            end.clear()
            seen.clear()
    yield rows()


# what the longer neighbour says
INSIDE_WORD, INSIDE_SENTENCE, AT_END = 3, 2, 1


def _continues(short: str, longer: str) -> int | None:
    """Where the shorter text stops in the longer one; None where it does not begin it."""
    if not short or len(longer) <= len(short) or not longer.startswith(short):
        return None
    rest = longer[len(short) :]
    if short.rstrip(_CLOSERS)[-1:] in _ENDS:
        return None
    if short[-1].isalnum() and rest[0].isalnum():
        return INSIDE_WORD
    r = rest.lstrip(_CLOSERS + " ")
    if not r or r[0] in _ENDS:
        return AT_END
    # a capital may begin the next sentence: that tells nothing
    return None if r[0].isupper() and rest[0].isspace() else INSIDE_SENTENCE


_NEAR = pa.schema([("tk", pa.int64()), ("said", pa.int32()), ("pid", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
NEAR = "tk long, said int, pid int, edge int, text string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text against its successor in a sorted part; the first and last texts are sent along for the seams."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    make = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NEAR)], schema=_NEAR)
    last = None
    for b in batches:
        out = []
        for tk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if last is None:
                out.append((tk, None, pid, 0, t))
            elif t != last[1]:
                said = _continues(last[1], t)
                if said:
                    out.append((last[0], said, pid, None, None))
            last = (tk, t)
        if out:
            yield make(out)
    if last is not None:
        yield make([(last[0], None, pid, 1, last[1])])


def _seams(batches):
    """The last text of a part against the first of the next part that has another text; a row or two per part."""
    import pandas as pd

    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values(["pid", "edge"]).to_dict("records")
    out = []
    for i, r in enumerate(rows):
        if r["edge"] == 1:
            nxt = next((q["text"] for q in rows[i + 1 :] if q["text"] != r["text"]), None)
            said = _continues(r["text"], nxt) if nxt is not None else None
            if said:
                out.append((r["tk"], said))
    yield pd.DataFrame(out, columns=["tk", "said"]).astype({"tk": "int64", "said": "int32"})


def shortened(keys: DataFrame) -> DataFrame:
    """(tk, said) of the texts (tk, key) that begin their successor in sorted order."""
    parts = keys.repartitionByRange("key").sortWithinPartitions("key").select("tk", "key")
    near = cut(parts.mapInArrow(_neighbours, NEAR))
    inner = near.where("said is not null").select("tk", "said")
    seams = near.where("edge is not null").select("tk", "pid", "edge", "text").coalesce(1).mapInPandas(_seams, "tk long, said int")
    return inner.unionByName(seams).groupBy("tk").agg(F.max("said").alias("said"))


def length_spikes(rows: DataFrame, least: int = 20, times: float = 5.0, reach: int = 4, from_tokens: int = 12) -> DataFrame:
    """(limit, tokens) at which unfinished answers pile up: ``times`` the mean of the ``reach`` lengths to either side.

    Lengths are tokens of a public tokenizer, as limits are; each limit has its
    own. Under ``from_tokens`` short answers pile up that nothing has cut.
    """
    h = rows.where("open and defect is null").where(F.col("tokens") >= from_tokens).groupBy("limit", "tokens").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("limit").orderBy("tokens").rangeBetween(-reach, reach)  # a row per length
    h = h.withColumn("_around", (F.sum("n").over(near) - F.col("n")) / (2 * reach))
    return h.where((F.col("n") >= least) & (F.col("n") >= times * F.greatest("_around", F.lit(1.0)))).select("limit", "tokens")


def broken_pairs(rows: DataFrame, response_id: Column, prompt: Column, caption: Column, limit: Column, least_share: float = 0.08, tokenizer_file: str = RANKS, parts: bool = False) -> DataFrame:
    """(response_id, defect_type): one row per distinct id with a defective answer.

    defect_type is empty, copied, refusal, language or truncated, the first that
    applies in this order. A null prompt is never copied and asks for no
    language. An answer without a sentence end is truncated where a mark at its
    end shows it, or a longer neighbour goes on inside the word or sentence, or
    its last words end at most ``least_share`` of the sentences they occur in (five
    times as much at a length spike); a neighbour that merely adds the full stop
    clears it, and a single word is taken as an answer. Null ids are left out, repeated rows count once. Texts are used whole.
    Neighbours, ends and their counts are taken over distinct texts, so an answer
    that a third of all rows repeat is one row of the sort. parts adds a column
    ``found_by``: rule, mark, word, sentence (both by a neighbour), spike or end.
    """
    d = rows.select(response_id.alias("response_id"), prompt.alias("p"), caption.alias("c"), limit.cast("int").alias("limit")).where("response_id is not null")
    judged = cut(d.mapInArrow(lambda it: _judge(it, tokenizer_file), ROWS).withColumn("tk", F.xxhash64("key")))
    # repeated answers are merged on the map side before texts are sorted or counted
    texts = cut(judged.where("key is not null and key != ''").groupBy("tk").agg(F.first("key").alias("key"), F.bool_or(~F.col("open") & F.col("defect").isNull()).alias("whole")))
    near = shortened(texts)
    whole = texts.where("whole").select("key").mapInArrow(_end_counts, "w1 string, w2 string, e long, m long")
    pair = whole.groupBy("w1", "w2").agg(F.sum("e").alias("e"), F.sum("m").alias("m"))
    ask = judged.where("open and defect is null").select("response_id", "sure", "marked", "tk", "w1", "w2", "n_words", "length", "tokens", "limit").distinct()
    pair = cut(pair)
    single = pair.groupBy("w2").agg(F.sum("e").alias("e1"), F.sum("m").alias("m1"))
    j = ask.join(pair, ["w1", "w2"], "left").join(single, "w2", "left").join(near, "tk", "left")
    spike = length_spikes(judged.select("response_id", "tk", "open", "defect", "tokens", "limit").distinct()).withColumn("_spike", F.lit(True))
    j = j.join(spike, ["limit", "tokens"], "left")
    both, one = F.coalesce(F.col("e") + F.col("m"), F.lit(0)), F.coalesce(F.col("e1") + F.col("m1"), F.lit(0))
    # the last word's own share stands for ten sightings of the pair
    alone = F.when(one > 0, F.col("e1") / one).otherwise(0.0)
    share = (F.coalesce("e", F.lit(0)) + 10 * alone) / (both + 10)
    bar = F.when(F.col("_spike"), F.lit(5 * least_share)).otherwise(F.lit(least_share))
    said = F.coalesce("said", F.lit(0))
    how = (
        F.when(F.col("sure"), "mark")
        .when((said == INSIDE_WORD) & (F.col("length") >= 4), "word")
        .when(said == AT_END, None)
        .when((said == INSIDE_SENTENCE) & (F.col("n_words") >= 6), "sentence")
        .when((F.col("n_words") == 1) & ~F.col("marked"), None)
        .when(share < least_share, "end")
        .when(share < bar, "spike")
    )
    by_rule = judged.where("defect is not null").select("response_id", F.col("defect").alias("defect_type"), F.lit("rule").alias("found_by"))
    by_cut = j.withColumn("found_by", how).where("found_by is not null").select("response_id", F.lit("truncated").alias("defect_type"), "found_by")
    order = F.element_at(F.create_map(*[x for i, k in enumerate(("empty", "copied", "refusal", "language", "truncated")) for x in (F.lit(k), F.lit(i))]), F.col("defect_type"))
    first = by_rule.unionByName(by_cut).groupBy("response_id").agg(F.min_by("defect_type", order).alias("defect_type"), F.min_by("found_by", order).alias("found_by"))
    return first if parts else first.drop("found_by")
