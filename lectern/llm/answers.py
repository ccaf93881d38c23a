"""Defects of prompt and response pairs, by ordered rules, every one of which is told.

Rules, in order: empty, copy, refusal, other_language, truncated. Each is told on its own, so a pair can have several
(defects); the first of them is the pair's main one. One pass over the pairs tells all rules but one, and counts what
answers end with, in each task before the shuffle. The one is the abrupt end that only the table can tell: an answer without a
closing mark is whole if its last two words (of a short one its last word) close answers at least as often, over all rows, as they
stand at the end of one that nothing closes. This compares two counts of the same table, so it doesn't depend on its size
beyond a floor of LEAST_ENDINGS, and what only cuts leave never becomes known, however many there are.

A null or blank answer is empty whatever the question; a null or empty question has no copy and no language. Rows repeated
whole give one row in defect_rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import BROADCAST_ROWS, cut, spread

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Closed answers that must end in a way for it to count as one.
LEAST_ENDINGS = 3
#: Parts that a hot ending is spread over where endings are too many to broadcast.
SALT = 16
FLUSH = 200_000

_FOLD = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüçñýÿœæ’‘", "aaaaaaeeeeiiiiooooouuuucnyyoa''")

#: Function words by which a language is told, folded, fixed lists.
WORDS = {
    "es": "el la los las lo un una unos unas de del a al en con por para sin sobre entre hasta desde segun tras durante y e o u ni que si pero porque cuando donde como cual cuales quien quienes cuanto cuantos cuanta cuantas este esta estos estas ese esa esos esas se su sus mi tu le les me te nos es son ser estan estar hay ha han fue era sera puede pueden debe deben no mas menos muy ya tambien solo cada otro otra otros otras todo toda todos todas antes despues hace hacer tiene tienen nunca siempre aun todavia asi ademas entonces aunque excepto",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas ao aos com por pelo pela pelos pelas para sem sobre entre ate desde apos durante e ou nem que se mas porque quando onde como qual quais quem quanto quantos quanta quantas este esta estes estas esse essa isso isto se seu sua seus suas lhe me te sao ser estao estar ha foi era sera pode podem deve devem nao mais menos muito ja tambem so cada outro outra outros outras todo toda todos todas antes depois faz fazer tem ter nunca sempre ainda assim alem entao porem embora exceto",
    "fr": "le la les un une des de du a au aux en dans avec par pour sans sur entre jusqu depuis apres pendant et ou ni que qui quoi si mais parce quand comme quel quelle quels quelles combien ce cet cette ces se son sa ses leur leurs mon votre vous nous il elle ils elles on est sont etre etait sera ete ont avoir peut peuvent doit doivent ne pas plus moins tres deja aussi chaque autre autres tout toute tous toutes avant fait faire jamais toujours encore environ puis donc alors ainsi vers chez sauf",
    "en": "the a an of to in on at by for from with without about between until since after during before and or nor but if that which who whom whose what when where why how this these those it its is are was were be been being has have had do does did can could may might must should will would not no more less very also only each every other another all any some your you their they he she his her we our i as than then there never always still yet again except",
    "it": "il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla in nel nello nella nei nelle con su sul sulla per senza tra fra fino dopo durante prima e o che se ma perche quando dove come quale quali chi quanto quanti questo questa questi queste si suo sua suoi mi ti ci sono essere era sara stato ha hanno avere puo possono deve devono non piu meno molto gia anche solo ogni altro altra altri altre tutto tutti tutte fare mai sempre ancora appena circa quindi allora poi oltre verso presso tranne ne",
    "de": "der die das den dem des ein eine einen einem einer eines von zu zum zur mit ohne uber unter zwischen bis seit nach wahrend vor bei aus auf an in im am und oder aber wenn weil dass ob als wie wo wer was wann warum welche welcher welches dieser diese dieses es er sie sein seine ihr ihre ihren ist sind war waren wird werden wurde hat haben kann konnen darf durfen muss mussen soll sollte nicht kein keine mehr weniger sehr auch nur jede jeder jedes andere alle man sich fur nie immer noch etwa dann also ausser damit",
}
_LANGUAGES = list(WORDS)
_SPOKEN = {w: [i for i, x in enumerate(_LANGUAGES) if w in WORDS[x].split()] for ws in WORDS.values() for w in ws.split()}
#: Letters and marks that belong to one of the languages, and what they elide; worth two words.
MARKS = {"es": "¿¡ñ", "pt": "ãõ", "fr": "œùûëï", "de": "ßäö"}
ELISIONS = {"fr": r"\b[ldnsj]['’]", "it": r"\b(?:l|d|un|dell|nell|all|dall|sull|c)['’]"}
_MARKS = [(_LANGUAGES.index(x), frozenset(m)) for x, m in MARKS.items()]
_ELISIONS = [(_LANGUAGES.index(x), re.compile(m)) for x, m in ELISIONS.items()]

#: Ways to decline, folded, by language: inability or unwillingness with a verb of answering, rules, reach, lack of what is needed. The core clause decides, not a polite opening.
REFUSALS = [
    # Spanish
    r"\bno (?:me |te |le |les )?(?:puedo|podemos|podre|podremos|voy a|debo|debemos|sabria|sabriamos|es posible) (?:ayudar|contestar|responder|atender|ofrecer|dar|proporcionar|facilitar|opinar|decir|pronunciar)",
    r"\b(?:prefiero|preferimos|opto por|debo) (?:abstenerme|abstenernos|no (?:responder|contestar|opinar|pronunciar))|\bno (?:la|lo|le|las|los|les) (?:atendere|respondere|contestare|ayudare)",
    r"\b(?:me|nos) (?:resulta|es) imposible|\bfuera de (?:mi|mis|nuestro|nuestras) (?:alcance|ambito|competencias?|funciones)|\bno puede (?:contestarse|responderse)",
    r"\b(?:incumple|viola|infringe|vulnera|contraviene|va contra|es contrari[oa] a) (?:mis|nuestras) (?:normas|reglas|directrices|politicas|instrucciones)",
    r"\bno (?:encuentro|hallo|tengo|dispongo de|cuento con|poseo) (?:la respuesta|(?:suficientes? )?(?:datos|informacion|elementos|medios)\b)|\bno (?:estoy|esta) autorizad[oa] a",
    r"\bmodelo de lenguaje|\bno (?:menciona|dice) nada (?:al respecto|sobre)|\bcomo (?:asistente|ia|inteligencia artificial)\b",
    # English
    r"\b(?:can't|cannot|can not|won't|will not be able to|am unable to|unable to|am not able to|not able to|not allowed to|decline to|would rather not|must not|prefer not to) (?:help|assist|answer|give|provide|discuss|comply|offer|advise|respond|say)",
    r"\b(?:beyond|outside) (?:what i can|my (?:scope|remit|reach|competence))|\bdo(?:n't| not) have (?:enough |sufficient |any )?(?:information|data|context|evidence|the answer)|\blanguage model|\bcannot be answered|\bsays nothing about|\b(?:against|breaks|violates) my (?:rules|guidelines|policy|policies|instructions)",
    r"\bi could ?n[o']t (?:say|find|tell)|\bi could not (?:say|find|tell)|\bcould not say|\bi (?:do not|don't) (?:know|find)|\b(?:did not|didn't|could not) find the answer",
    # Portuguese
    r"\bnao (?:me e possivel|posso|podemos|consigo|devo|vou|saberia|sei) (?:ajudar|responder|dar|opinar|atender|dizer|oferecer|fornecer)|\bprefiro (?:nao|abster)|\bnao saberia|\bnao permite responder|\bnao pode ser respondid",
    r"\bmodelo de linguagem|\bfora do meu (?:alcance|ambito)|\b(?:viola|infringe|contraria) as minhas (?:regras|normas|diretrizes|instrucoes)|\bnada (?:diz|refere) sobre",
    r"\bnao (?:encontro|tenho|disponho de|possuo) (?:a resposta|(?:dados|informac|elementos))|\bnao estou autorizad[oa]|\be-me impossivel|\bimpossivel dar uma resposta",
    # French
    r"\bne (?:peux|puis|pouvons|saurais|saurions|m'est|veux|vais|dois) (?:pas |)(?:vous |me |)(?:aider|repondre|donner|dire|traiter|satisfaire|possible|prononcer|fournir)|\bprefere (?:m'abstenir|ne pas)|\bpas autorisee? a|\bne permet pas de repondre",
    r"\bmodele de langage|\bau-dela de ce que|\bhors de m(?:a|es) (?:portee|competences?|attributions)|\bcontraire a mes (?:regles|consignes|principes|directives|instructions)|\bne dit rien",
    r"\bne (?:trouve|dispose|possede) pas|\bn'ai pas (?:assez|suffisamment|trouve|le droit)|\bimpossible de (?:donner|repondre|vous)|\bne peut (?:pas |)(?:etre repondu|recevoir de reponse)",
]

#: Words after which a sentence can't end, folded.
OPEN_WORDS = frozenset("de del la el los las un una unos unas y e o u que con por para en al a su sus segun se si como entre sin sobre cuando donde desde hasta pero lo da do das dos os as em com uma um ao nos no na nas pelo pela ou mas le les des du et ou avec pour par sur dans une au aux qui dont si mais the of and or with which to in for from by at an as that if but when is are was per when than se sont est es son sao e".split())

#: Answers that stand for nothing, folded and without outer marks.
BLANKS = frozenset(["n/a", "na", "n/d", "nd", "n.a", "n.d", "null", "none", "nil", "nan", "undefined", "respuesta", "answer", "resposta", "reponse", "a", "r", "tbd", "todo", "vacio", "sin respuesta", "empty", "no answer", "s/r"])


_REFUSAL = re.compile(r"\b(?:" + "|".join(r.removeprefix(r"\b").replace(r"|\b", "|") for r in REFUSALS) + ")")
_WORD = re.compile(r"[^\W_]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_BROKEN = re.compile(r"(?:\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|[,;:(\[{«“\-–—/])$")
_CLOSED = re.compile(r"[.!?。！？][\"»”’')\]]*$")
_FIGURE, _NAME, _TWO = re.compile(r"\d+(?:[.,]\d+)*"), re.compile(r"(?<=\s)[^\W\d_a-zß-öø-ÿ][^\W\d_-]*[\w-]{4,}"), re.compile(r"\S+\s+\S+$")
#: Numbers of documents, whose letters are no words.
_CODE = re.compile(r"(?<![^\W_])[A-Z]+-\d+")
_DENIALS = frozenset("no not non nao ne pas si sim oui yes never nunca jamais".split())
_PAIRS = (("(", ")"), ("[", "]"), ("«", "»"), ("“", "”"), ("{", "}"))
#: Marks at which an answer's last words end.
_STOPS = " \t\n\r\x0b\x0c.!?…\"»”’')]"


#: The same by byte, for texts within Latin-1.
_FOLD_BYTES = bytes(_FOLD.get(b, b) for b in range(256))


def folded(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text
    try:
        return text.encode("latin-1").translate(_FOLD_BYTES).decode("latin-1")
    except UnicodeEncodeError:
        return text.translate(_FOLD)


def _trimmed(text: str) -> str:
    """Without separators, controls and unassigned characters at both ends."""
    out = lambda c: unicodedata.category(c)[0] in "ZC"
    i, j = 0, len(text)
    while i < j and out(text[i]):
        i += 1
    while j > i and out(text[j - 1]):
        j -= 1
    return text[i:j]


def ending(text: str) -> str:
    """The last two words of an answer, figures as 0, words with a capital inside a sentence as N; what a bracket adds at the end stays out."""
    whole = text.rstrip().rstrip(".!?…").rstrip()
    if whole.endswith(")") and (at := whole.rfind("(")) >= 0 and ")" not in whole[at:-1]:
        text = whole[:at]
    shaped = _NAME.sub("N", _FIGURE.sub("0", text.rstrip(_STOPS)))
    found = _TWO.search(shaped[-60:])
    return folded(found.group()) if found else ""


def _language(words: set[str], text: str, signs: set[str]) -> list[int]:
    """What speaks for each language in a text in lower case, its distinct words and its distinct characters."""
    hits = [0] * len(_LANGUAGES)
    for w in words & _SPOKEN.keys():
        for i in _SPOKEN[w]:
            hits[i] += 1
    if "'" in signs or "’" in signs:
        for i, elision in _ELISIONS:
            if elision.search(text):
                hits[i] += 2
    for i, mark in _MARKS:
        if not mark.isdisjoint(signs):
            hits[i] += 2
    return hits


def _script(text: str, signs: set[str]) -> bool | None:
    """Whether most letters of a text are Latin; None if it has less than five."""
    if max(signs, default="") < "\u0250":
        return True if len(text) > 40 or sum(map(str.isalpha, text)) >= 5 else None
    letters = [c for c in text if c.isalpha()]
    latin = sum(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in letters)
    return 2 * latin > len(letters) if len(letters) >= 5 else None


class Pair:
    """What the rules tell of one pair: defects that need no table, and for an answer that nothing closes what to look up."""

    __slots__ = ("closes", "defects", "inside", "last", "open_end")

    def __init__(self, question: str | None, answer: str | None):
        t = _trimmed(answer or "")
        f, q = folded(t), question or ""
        words = _WORD.findall(f)
        self.defects: list[str] = []
        self.closes = self.open_end = self.last = ""
        self.inside = words
        bare = _OUTER.sub("", f)
        if not bare or bare in BLANKS:
            self.defects.append("empty")
        else:
            self._answered(t, f, words, q)

    def _answered(self, t: str, f: str, words: list[str], q: str) -> None:
        asked, said = set(_WORD.findall(folded(q))), set(words)
        extra = said - asked
        if asked and len(said & asked) >= 0.8 * len(asked) and len(extra) <= 3 and not extra & _DENIALS:
            self.defects.append("copy")
        if _REFUSAL.search(f):
            self.defects.append("refusal")
        if self._foreign(t, said, q, asked):
            self.defects.append("other_language")
        opened = any(o in t and t.count(o) > t.count(c) for o, c in _PAIRS) or t.count('"') % 2 == 1
        broken = _BROKEN.search(t) is not None
        closed = not broken and _CLOSED.search(t) is not None
        n = len(t.split())
        hangs = n >= 2 and bool(words) and words[-1] in OPEN_WORDS
        if broken or opened or (hangs and not closed):
            self.defects.append("truncated")
        if closed:
            if not opened and not hangs:
                self.closes = ending(t)
            return
        self.inside = words[:-1]
        if words and not (broken or opened or hangs):
            if n >= 6:
                self.open_end = ending(t) or "?"
            elif n >= 4 and not words[-1].isdecimal():
                self.last = words[-1]

    @staticmethod
    def _foreign(t: str, said: set[str], q: str, asked: set[str]) -> bool:
        low_q, low_t = q.lower(), t.lower()
        signs_q, signs_t = set(low_q), set(low_t)
        script_q, script_t = _script(q, signs_q), _script(t, signs_t)
        if script_q is not None and script_t is not None and script_q != script_t:
            return True
        if _CODE.search(t):
            said = set(_WORD.findall(folded(_CODE.sub(" ", t))))
        hq, ha = _language(asked, low_q, signs_q), _language(said, low_t, signs_t)
        best = max(hq)
        same = max(a for a, h in zip(ha, hq) if h == best)
        return best > 0 and max(ha) >= 2 and max(ha) >= same + 2


#: What a term of the table is: an ending of two words, or a single word.
_END, _SINGLE = "e ", "w "


def _scan(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed: Counter = Counter()
        left: Counter = Counter()

        def counts() -> pa.RecordBatch:
            terms = list(closed.keys() | left.keys())
            n = len(terms)
            out = pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.string())), pa.array(terms, pa.string()), pa.array([closed[x] for x in terms], pa.int64()), pa.array([left[x] for x in terms], pa.int64())], names=[key, "defects", "term", "closed", "left"])
            closed.clear(), left.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            defects, terms = [], []
            for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                p = Pair(q, a)
                term = _END + p.open_end if p.open_end else _SINGLE + p.last if p.last else None
                defects.append(p.defects), terms.append(term)
                if p.closes:
                    closed[_END + p.closes] += 1
                for w in set(p.inside):
                    closed[_SINGLE + w] += 1
                if term:
                    left[term] += 1
            none = pa.nulls(len(terms), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(defects, pa.list_(pa.string())), pa.array(terms, pa.string()), none, none], names=[key, "defects", "term", "closed", "left"])
            if len(closed) + len(left) > FLUSH:
                yield counts()
        if closed or left:
            yield counts()

    return run


def scored(pairs: DataFrame, key: str = "qa_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(key, defects ARRAY<STRING>) of every row, in the order of the rules."""
    src = spread(pairs.select(F.col(key).alias("_k"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a")))
    kind = src.schema["_k"].dataType.simpleString()
    told = cut(src.mapInArrow(_scan("_k"), f"_k {kind}, defects array<string>, term string, closed bigint, left bigint"))
    rows = told.filter("defects is not null").select("_k", "defects", "term")
    sure, open_ = rows.filter("term is null"), rows.filter("term is not null")
    counts = told.filter("defects is null").groupBy("term").agg(F.sum("closed").alias("closed"), F.sum("left").alias("left"))
    # of the terms only those that are to be looked up, which have a row among the open ones
    known = cut(counts.filter(f"left > 0 and closed >= {LEAST_ENDINGS} and closed >= left").select("term", F.lit(True).alias("known")))
    if known.count() <= BROADCAST_ROWS:
        met = open_.join(F.broadcast(known), "term", "left")
    else:
        salted = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = open_.withColumn("_s", F.pmod(F.xxhash64("_k"), F.lit(SALT)).cast("int")).join(salted, ["term", "_s"], "left")
    cut_off = F.when(F.col("known").isNull(), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    both = sure.select("_k", "defects").unionByName(met.select("_k", F.concat("defects", cut_off).alias("defects")))
    return both.select(F.col("_k").alias(key), "defects")


def defect_rows(pairs: DataFrame, key: str = "qa_id", **names) -> DataFrame:
    """(key, defect): the first defect of each defective pair, once for each key."""
    return scored(pairs, key, **names).filter(F.size("defects") > 0).select(key, F.element_at("defects", 1).alias("defect")).distinct()
