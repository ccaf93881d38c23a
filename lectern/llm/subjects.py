"""Subject areas of documents, from labelling functions and a latent model that learns how far each can be trusted.

Every sentence gets votes of four labelling functions, each for one subject or none:
  lexicon  words whose use by hand-labelled documents points at a subject,
  seeds    stems written down for each subject, in four languages,
  section  the heading or web address over or in the sentence, where labelled documents tie it to a subject,
  source   the source and holder of the document, likewise.
The votes are counted by pattern over the whole corpus (at most (subjects + 1)^4 patterns); from these counts expectation
maximisation learns each function's accuracy and coverage and the subjects' shares; how far votes agree with the labels is the prior of
the accuracies. A sentence's posterior is that of its pattern, whichever functions voted; a document treats the subjects whose posterior share of its sentences is at least a fifth.

Null, empty and blank texts, and texts without a sentence, have no row. Sentences that no function knows count as sentences
but treat nothing. Repeated rows of one id are read once. Without labels the seeds decide alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut, lookup, spread

#: Words and places that tell a subject, at most.
LEXICON = 500_000
#: Weight of labels and prior beliefs beside the corpus in what is learned of the labelling functions, for each vote of the corpus.
TRUST = 1.0
#: Share of its sentences that a document must give to a subject.
LEAST_SHARE = 0.2
#: Standard errors by which the log odds of a word must stand out.
LEAST_SCORE = 3.5
FUNCTIONS = ("lexicon", "seeds", "section", "source")

#: Stems without accents; a word votes by its longest stem.
SEEDS = {
    "medicine": "pacient patient embaraz gravid enceint pregnan enferm infirmi nurse nausea tontur vertig dizz migran migrain jarabe xarope sirop fiebre febre fievre fever alergi dolor pauta sintom breastfeed kidney swallow urgenc",
    "science": "placebo cohort hipotes hypothes plasma farmacocin pharmaco espectrom spectrom multivari aleatori randomis receptor recepteur semivida sesgo biais replic investigador correlacion correlat endpoint",
    "law": "tribunal court clausul patent brevet reglament regulament reglem sancion multa coima amende demandant deroga revoga abroge juridic inspecc alzada etiquetado rotulag publicidad sentenc ruling incumplim licence licenc",
    "sport": "atlet athlet dopaj dopag doping arbitr medall medalh medail maraton marathon ciclist cyclist federac competic competit corredor entrenad treinad entrain coach orina urina temporada referee",
    "software": "servidor serveur server script usuari utilizad utilisat contrasen password senha indexa sincron synchron interfaz interfac modulo module migrac administrador sistema database error codigos",
    "economics": "precio preco prix price copago copagam factur presupuest orcament budget asegurador segurador assureur insurer mayorist grossist wholesal descuent desconto remise discount mercado marche market comprador buyer financi subasta margen margem marge",
    "veterinary": "perro cachorr chien yegua egua jument ganad troupeau herd porcin suin ruminal pienso veterin lechon leitao porcel piglet cojera canin equin matader antiparasit rebano feline chevrett",
    "nutrition": "dieta dietet calori gluten proteic legumbr legumin calcio calcium hierro vitamin desayun breakfast grasa gordura edulcor adocant sweeten pomelo menu folico nutric nutrit fiber fibra",
    "manufacturing": "reactor reator reacteur envasad embalag packag granulac granulat excipient estearat stearat tolva tremie hopper compresor prensa liofiliz freeze recubr revest enrob coating secador secheur dryer piloto tamiz steril esteril",
    "education": "profesor professor teacher alumn aluno eleve student seminari leccion licao lecon lesson rubric temari facultad faculdad ensenan curso exercic ejercic aula classroom califica taller workshop evalua ensino",
}

_END = re.compile(r"[.!?…][\"'»”’)\]]*(?=\s|$)|\n[^\S\n]*\n")
#: Short forms whose full stop ends no sentence.
_SHORT = ("ref", "doc", "pág", "pag", "art", "vol", "núm", "rev", "no", "fig", "dr", "sr")
_OUTER = ".,;:!?()[]\"'«»“”‘’¿¡…–—•-*|·"
_ADDRESS = re.compile(r"(?:https?://|www\.)([\w.-]+)|[\w.+-]+@([\w.-]+\.\w+)")
#: Words that a stretch needs to be a sentence, and needs where nothing closes it.
SHORTEST, SHORTEST_OPEN = 4, 8


def folded(w: str) -> str:
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _short(text: str, end: int) -> bool:
    word = text[max(0, end - 5) : end]
    return word.lower().endswith(_SHORT) and not word[-4 if word.lower().endswith(("pág", "pag", "núm", "doc", "ref", "art", "vol", "rev", "fig")) else -3 :][:1].isalpha()


def sentences(text: str) -> Iterator[tuple[str, list[str]]]:
    """(heading, tokens) of each sentence, in lower case. Lines without an end before it, short and apart, are headings; tables and runs without words are no sentences."""
    at, heading = 0, ""
    for m in [*_END.finditer(text), None]:
        if m and m.group()[0] == "." and _short(text, m.start()):
            continue
        part = text[at : m.start() if m else len(text)]
        closed = bool(m) and m.group()[0] != "\n"
        at = m.end() if m else len(text)
        if len(part) < 12:
            continue
        first, _, rest = part.lstrip().partition("\n")
        if rest and len(first) <= 40 and first.count(" ") < 5 and not first[-1:].isdigit():
            heading = first.strip().lower()
        tokens = part.lower().split()
        if len(tokens) >= (SHORTEST if closed else SHORTEST_OPEN) and len(part) < 16 * len(tokens):
            yield heading, tokens


def core(token: str) -> str | None:
    """The word in a token, without outer marks and what is elided before an apostrophe; None for figures, codes and the like."""
    w = token.strip(_OUTER).replace("’", "'").rpartition("'")[2]
    return w if len(w) > 1 and (w.isalpha() or all(x.isalpha() for x in w.split("-"))) else None


class Voter:
    def __init__(self, subjects: list[str], lexicon: dict[str, tuple[int, float]], sections: dict[str, int], sources: dict[str, int]):
        self.subjects, self.lexicon, self.sections, self.sources = subjects, lexicon, sections, sources
        place = {s: i for i, s in enumerate(subjects)}
        self.stems = {stem: place[s] for s, stems in SEEDS.items() if s in place for stem in stems.split()}
        #: what a token tells: (subject by lexicon, weight, subject by seeds), None for a word that tells nothing, 1 for no word
        self.met: dict[str, tuple | int | None] = {}

    def tells(self, token: str) -> tuple | int | None:
        w = core(token)
        if w is None:
            return 1
        f = folded(w)
        seed = next((self.stems[f[:n]] for n in range(min(len(f), 12), 3, -1) if f[:n] in self.stems), -1)
        hit = self.lexicon.get(w, (-1, 0.0))
        got = None if seed < 0 and hit[0] < 0 else (*hit, seed)
        if len(self.met) > 500_000:
            self.met.clear()
        self.met[token] = got
        return got

    def votes(self, heading: str, tokens: list[str], source: int) -> int:
        """The pattern of a sentence's votes as one number, in base subjects + 1; 0 stands for no vote. -1 if too few tokens are words."""
        known, told, words = self.met.get, [], 0
        for t in tokens:
            x = known(t, 0)
            if x == 0:
                x = self.tells(t)
            if x is None:
                words += 1
            elif x != 1:
                words += 1
                told.append(x)
        if words < SHORTEST:
            return -1
        one = two = -1
        if told:
            weigh: dict[int, float] = {}
            seen: dict[int, int] = {}
            for s, w, z in set(told):
                if s >= 0:
                    weigh[s] = weigh.get(s, 0.0) + w
                if z >= 0:
                    seen[z] = seen.get(z, 0) + 1
            if weigh:
                one = max(weigh, key=lambda s: (weigh[s], -s))
            if seen:
                two = max(seen, key=lambda s: (seen[s], -s))
        n = len(self.subjects) + 1
        return ((one + 1) * n + two + 1) * n * n + (self.sections.get(heading, -1) + 1) * n + source + 1

    def document(self, text: str, source: str | None, holder: str | None) -> Counter:
        where = self.sources.get(f"s:{source}", self.sources.get(f"h:{holder}", -1))
        sites = [a or b for a, b in _ADDRESS.findall(text)] if "@" in text or "www." in text or "://" in text else []
        site = next((s.lower() for s in sites if s.lower() in self.sections), None)
        got = Counter(self.votes(site or h, w, where) for h, w in sentences(text))
        got.pop(-1, None)
        return got


def telling(uses: dict[str, int], docs: dict[str, int], least_score: float = LEAST_SCORE) -> tuple[str, float] | None:
    """(subject, weight) that a thing points at, by the labelled documents of each subject that have it; the weight is a smoothed log odds, which must stand out from its standard error."""
    total, n = sum(docs.values()), sum(uses.values())
    # of the shares within each subject, so that large subjects don't own every common word
    best = max(uses, key=lambda s: (uses[s] / docs[s], s))
    x, y = uses[best] + 0.5, n - uses[best] + 0.5
    nx, ny = docs[best] - uses[best] + 0.5, total - docs[best] - n + uses[best] + 0.5
    odds = log(x / nx) - log(y / ny)
    return (best, odds) if odds > least_score * (1 / x + 1 / y + 1 / nx + 1 / ny) ** 0.5 and odds > 2 else None


def single_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, subject) of the documents that are labelled with one subject."""
    return labels.select(key, "subject").filter("subject is not null").distinct().groupBy(key).agg(F.collect_set("subject").alias("s")).filter(F.size("s") == 1).select(key, F.element_at("s", 1).alias("subject"))


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, thing, subject, n): labelled documents of a subject that have a word (w), a heading or address (x), a source (s) or holder (h); and those of the subject at all (d)."""
    counts: Counter = Counter()

    def told() -> pa.RecordBatch:
        rows = list(counts.items())
        out = pa.RecordBatch.from_arrays([*[pa.array([k[i] for k, _ in rows], pa.string()) for i in range(3)], pa.array([n for _, n in rows], pa.int64())], names=["kind", "thing", "subject", "n"])
        counts.clear()
        return out

    for batch in batches:
        for t, source, holder, subject in zip(*[c.to_pylist() for c in batch.columns]):
            words, heads = set(), set()
            for h, w in sentences(t):
                words.update(c for x in w if (c := core(x)))
                heads.add(h)
            heads |= {(a or b).lower() for a, b in _ADDRESS.findall(t)}
            counts.update([("w", x, subject) for x in words])
            counts.update([("x", x, subject) for x in heads if x])
            counts.update([("s", str(source), subject), ("h", str(holder), subject), ("d", "", subject)])
        if len(counts) > 200_000:
            yield told()
    yield told()


def fit_voter(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", bound: int = LEXICON) -> Voter:
    """The labelling functions, from all documents that are labelled with one subject. Only what tells a subject comes to the driver; more than `bound` of it raises an error."""
    names = sorted(r[0] for r in subjects.select("subject").filter("subject is not null").distinct().collect())
    one = cut(single_labels(labels, key).filter(F.col("subject").isin(names)))
    rows = spread(lookup(documents.select(key, "text", "source", "holder").filter("text is not null"), one, key).select("text", "source", "holder", "subject"))
    counted = cut(rows.mapInArrow(_uses, "kind string, thing string, subject string, n bigint").groupBy("kind", "thing", "subject").agg(F.sum("n").alias("n")))
    docs = {r["subject"]: r["n"] for r in counted.filter("kind = 'd'").collect()}

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, thing, uses in zip(*[c.to_pylist() for c in batch.columns]):
                if (got := telling({u["subject"]: u["n"] for u in uses}, docs)) is not None:
                    out.append((kind, thing, *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["kind", "thing", "subject", "weight"])

    found = counted.filter("kind <> 'd'").groupBy("kind", "thing").agg(F.collect_list(F.struct("subject", "n")).alias("uses")).mapInArrow(tell, "kind string, thing string, subject string, weight double").limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"more than {bound} words and places tell a subject")
    place = {n: i for i, n in enumerate(names)}
    lexicon = {r["thing"]: (place[r["subject"]], r["weight"]) for r in found if r["kind"] == "w"}
    sections = {r["thing"]: place[r["subject"]] for r in found if r["kind"] == "x"}
    sources = {f"{r['kind']}:{r['thing']}": place[r["subject"]] for r in found if r["kind"] in "sh"}
    return Voter(names, lexicon, sections, sources)


def posteriors(counts: dict[int, float], subjects: int, labelled: dict[tuple[int, int], float] | None = None, rounds: int = 60, trust: float = TRUST) -> tuple[dict[int, np.ndarray], dict[str, tuple[float, float]]]:
    """({pattern: posterior over subjects and none}, {function: (accuracy, coverage)}) by expectation maximisation over counted patterns.

    labelled: sentences of documents with one label, by (pattern, subject). How often a function's votes agree with them is the prior of its accuracy, with the weight of
    `trust` votes for each vote of the corpus; so what the corpus says moves it, and without labels it's all there is. How often a function votes on sentences that treat nothing
    is taken to be rare for words and common for places, by a prior of the same weight.
    """
    n, k = subjects + 1, subjects
    patterns = sorted(counts)
    v = np.array([[p // n**3, p // n**2 % n, p // n % n, p % n] for p in patterns], dtype=int).reshape(-1, 4) - 1
    c = np.array([counts[p] for p in patterns], float)
    prior = np.full(k + 1, 0.9 / k)
    prior[k] = 0.1
    start = np.array([0.95, 0.95, 0.5, 0.5])
    if labelled:
        for j in range(4):
            votes = [(p // n ** (3 - j) % n - 1, s, m) for (p, s), m in labelled.items()]
            cast = sum(m for x, _, m in votes if x >= 0)
            # with few votes what is thought beforehand stays
            start[j] = (sum(m for x, s, m in votes if x == s) + 20 * start[j]) / (cast + 20)
    idle = np.array([0.02, 0.02, 0.4, 0.6])
    accuracy, coverage, noise = start.copy(), np.array([0.8, 0.7, 0.3, 0.5]), idle.copy()
    post = np.full((len(v), k + 1), 1 / (k + 1))
    for _ in range(rounds if len(v) else 0):
        like = np.log(prior + 1e-12)[None, :].repeat(len(v), 0)
        for j in range(4):
            voted = v[:, j] >= 0
            wrong = np.log((1 - accuracy[j]) / (k - 1)) if k > 1 else np.log(1e-9)
            like[~voted, :k] += np.log(1 - coverage[j])
            like[~voted, k] += np.log(1 - noise[j])
            like[voted, :k] += np.log(coverage[j]) + wrong
            like[voted, k] += np.log(noise[j] / k)
            rows = np.flatnonzero(voted)
            like[rows, v[rows, j]] += np.log(accuracy[j]) - wrong
        post = np.exp(like - like.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        w = post * c[:, None]
        prior = (w.sum(0) + 1) / (w.sum() + k + 1)
        some = w[:, :k].sum(1)
        for j in range(4):
            voted = v[:, j] >= 0
            cast = some[voted].sum()
            right = w[np.flatnonzero(voted), v[voted, j]].sum()
            weight = trust * c[voted].sum() + 10
            accuracy[j] = np.clip((right + weight * start[j]) / (cast + weight), 1e-3, 1 - 1e-3)
            coverage[j] = np.clip((cast + 5) / (some.sum() + 10), 1e-3, 1 - 1e-3)
            noise[j] = np.clip((w[voted, k].sum() + weight * idle[j]) / (w[:, k].sum() + weight), 1e-3, 1 - 1e-3)
    # where no function votes nothing is told
    bare = (v < 0).all(1) if len(v) else np.zeros(0, bool)
    post[bare] = 0
    post[bare, k] = 1
    return dict(zip(patterns, post)), {f: (float(a), float(b)) for f, a, b in zip(FUNCTIONS, accuracy, coverage)}


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", least: float = LEAST_SHARE, voter: Voter | None = None) -> DataFrame:
    """(key, subject, share) of the subjects that each document treats."""
    spark = documents.sparkSession
    voter = voter or fit_voter(documents, labels, subjects, key)
    shared = spark.sparkContext.broadcast(voter)
    src = spread(documents.select(F.col(key).alias("_k"), F.col("text").cast("string").alias("_t"), "source", "holder").filter("_t is not null and _t <> ''"))
    kind = src.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            keys, patterns, times = [], [], []
            for k, t, s, h in zip(*[c.to_pylist() for c in batch.columns]):
                for p, n in v.document(t, s, h).items():
                    keys.append(k), patterns.append(p), times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(patterns, pa.int64()), pa.array(times, pa.int64())], names=["_k", "pattern", "n"])

    votes = cut(src.mapInArrow(run, f"_k {kind}, pattern bigint, n bigint"))
    counts = {r["pattern"]: float(r["n"]) for r in votes.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    place = {s: i for i, s in enumerate(voter.subjects)}
    # at most (subjects + 1)^4 patterns for each subject
    labelled = lookup(votes, cut(single_labels(labels, key).withColumnRenamed(key, "_k")), "_k").groupBy("pattern", "subject").agg(F.sum("n").alias("n")).collect()
    post, _ = posteriors(counts, len(voter.subjects), {(r["pattern"], place[r["subject"]]): float(r["n"]) for r in labelled if r["subject"] in place})
    table = [(p, s, float(x[i])) for p, x in post.items() for i, s in enumerate(voter.subjects) if x[i] > 0.01]
    # at most (subjects + 1)^4 patterns
    belief = F.broadcast(spark.createDataFrame(table, "pattern bigint, subject string, belief double"))
    votes = votes.dropDuplicates(["_k", "pattern"])
    size = votes.groupBy("_k").agg(F.sum("n").alias("sentences"))
    parts = votes.join(belief, "pattern").groupBy("_k", "subject").agg(F.sum(F.col("n") * F.col("belief")).alias("treated"))
    share = parts.join(size, "_k").select(F.col("_k").alias(key), "subject", (F.col("treated") / F.col("sentences")).alias("share"))
    # posteriors fall short of whole sentences by a hair
    return share.filter(F.col("share") >= least - 0.005)


def held_out_accuracy(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id") -> DataFrame:
    """(labelled, found, both, precision, recall), one row: subjects of the documents whose labels, half of all by a hash of their key, no part of the model has seen."""
    hidden = F.pmod(F.xxhash64(key, F.lit("half")), F.lit(2)) == 1
    known, held = labels.filter(~hidden), labels.filter(hidden).select(key, "subject").filter("subject is not null").distinct()
    keys = held.select(key).distinct()
    got = document_subjects(documents, known, subjects, key).select(key, "subject").join(keys, key, "left_semi").withColumn("found", F.lit(1))
    both = held.join(documents.select(key).distinct(), key, "left_semi").withColumn("labelled", F.lit(1)).join(got, [key, "subject"], "full")
    s = both.agg(F.count("labelled").alias("labelled"), F.count("found").alias("found"), F.count(F.when(F.col("labelled").isNotNull() & F.col("found").isNotNull(), 1)).alias("both"))
    return s.select("*", F.round(F.try_divide("both", "found"), 3).alias("precision"), F.round(F.try_divide("both", "labelled"), 3).alias("recall"))
