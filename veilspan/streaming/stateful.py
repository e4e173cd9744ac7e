"""Page-by-page propagation with keyed state: what a document has said so far lives in the state store.

Pages arrive in any batches. Detection is a Column over a page's text; the state of a document is its list of
clusters (``operators.leaders``), so that a new page is searched for the texts of all earlier ones without their spans being
read again: a batch costs what its pages and their documents' clusters cost, however many batches came before. A page that
overtakes its predecessors waits in the state, a page that comes again is left out. An end mark (a row with the index
after the last page and a null text) closes a document: waiting pages are worked off in order and its state is freed.

Rules are those of the stream's start; resuming from the checkpoint reads them anew. Up to ``MOST_RULES`` travel with the
function; more are stored in files by a hash of their text, of which a worker holds a bounded number.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Container, Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.leaders import Leaders
from ..operators.places import fuzzy, normalize, variant_places
from ..operators.propagate import DECAY
from .progressive import MOST_RULES, STEP

#: Rules of a file about, and files that a worker holds at a time.
FILE_RULES, FILES_HELD = 2_000, 100

_FIELDS = [f.split(" ")[0] for f in STEP.split(", ")]
#: What the state keeps: a document's clusters, the pages that wait, and the index of the page that comes next.
CLUSTER = "text string, norm_text string, fuzzy string, variants array<string>, label string, confidence double, source string"
WAITING = "page_index int, text string, own string"


class Labels(Protocol):
    """The labels of overridden texts, as a dict has them."""

    def get(self, norm: str, default: str, /) -> str: ...


@lru_cache(maxsize=FILES_HELD)
def _file_rules(path: str, bucket: int) -> tuple[frozenset[str], dict[str, str]]:
    system, base = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(f"{base}/bucket={bucket}", allow_not_found=True))
    rows = [r for f in found if f.base_name.endswith(".parquet") for r in pq.ParquetFile(system.open_input_file(f.path)).read().to_pylist()]
    return frozenset(r["norm_text"] for r in rows if r["kind"] == "suppress"), {r["norm_text"]: r["label"] for r in rows if r["kind"] == "override"}


class StoredRules:
    """Rules in a folder of files: which texts are suppressed (``in``), and the labels of overridden ones (``get``)."""

    def __init__(self, path: str, buckets: int) -> None:
        self._path, self._buckets = path, buckets

    def _of(self, norm: str | None) -> tuple[frozenset[str], dict[str, str]]:
        return _file_rules(self._path, zlib.crc32((norm or "").encode("utf-8", "surrogatepass")) % self._buckets)

    def __contains__(self, norm: str) -> bool:
        return norm in self._of(norm)[0]

    def get(self, norm: str, default: str) -> str:
        return self._of(norm)[1].get(norm, default)


def store_rules(rules: DataFrame, path: str) -> StoredRules:
    """Writes rules (kind, norm_text, label) to a new folder that driver and executors share."""
    buckets = max(rules.count() // FILE_RULES, 1)
    bucket = F.crc32(F.encode(F.coalesce("norm_text", F.lit("")), "UTF-8")) % buckets
    rules.select("kind", "norm_text", "label", bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(path)
    whole = rules.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return StoredRules(whole.getFileSystem(rules.sparkSession._jsc.hadoopConfiguration()).makeQualified(whole).toUri().toString(), buckets)


def places(clusters: list[dict], text: str) -> Iterator[tuple[int, int, int]]:
    """(cluster, start, end) in order of cluster, variant and start, each once for a cluster."""
    seen = set()
    for k, _, a, b in variant_places((c["variants"] for c in clusters), text):
        if (k, a, b) not in seen:
            seen.add((k, a, b))
            yield k, a, b


def page_step(known: Leaders, page_index: int, text: str, own: list[dict], suppressed: Container[str], labels: Labels) -> list[tuple]:
    """The spans of one page, (page_index, label, text, ...) without the document's id; ``known`` takes them in."""
    own = [{**s, "label": labels.get(s["norm_text"], s["label"])} for s in own if s["norm_text"] not in suppressed]
    ordered = lambda spans: sorted(spans, key=lambda s: (s["char_start"], s["char_end"], s["label"]))
    add = lambda to, s: to.add(s["text"], s["norm_text"], fuzzy(s["text"]), s["label"], s["confidence"], s["source"])
    # the page's own texts count in the search; what it leaves behind is told in order of place, with what the search brings
    known.begin()
    for s in ordered(own):
        add(known, s)
    covered, brought = [(s["char_start"], s["char_end"]) for s in own], []
    for k, a, b in places(known.clusters, text):
        norm = normalize(text[a:b])
        if norm in suppressed or any(x < b and y > a for x, y in covered):
            continue
        covered.append((a, b))
        c = known.clusters[k]
        brought.append({"label": labels.get(norm, c["label"]), "text": text[a:b], "norm_text": norm, "confidence": c["confidence"] * DECAY, "source": c["source"], "char_start": a, "char_end": b})
    known.undo()
    spans = ordered(own + brought)
    for s in spans:
        add(known, s)
    return [(page_index, s["label"], s["text"], s["norm_text"], s["confidence"], s["source"], s["char_start"], s["char_end"]) for s in spans]


class PageProcessor(StatefulProcessor):
    """Works off a document's pages in order of their index."""

    def __init__(self, suppressed: Container[str], labels: Labels) -> None:
        self._suppressed, self._labels = suppressed, labels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._clusters = handle.getListState("clusters", CLUSTER)
        self._waiting = handle.getListState("waiting", WAITING)
        self._next = handle.getValueState("next", "page_index int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        come = [(int(i), t, o) for pages in rows for i, t, o in zip(pages["page_index"], pages["text"], pages["own"], strict=True)]
        upcoming = self._next.get()[0] if self._next.exists() else 0
        come += [tuple(r) for r in self._waiting.get()]
        pages = {i: (t, o) for i, t, o in sorted(come, key=lambda p: p[0], reverse=True) if i >= upcoming}
        closed = any(t is None for t, _ in pages.values())
        names = ["text", "norm_text", "fuzzy", "variants", "label", "confidence", "source"]
        known = Leaders({**dict(zip(names, c, strict=True)), "variants": list(c[3])} for c in self._clusters.get())
        out = []
        for i in sorted(pages):
            if i != upcoming and not closed:
                break
            text, own = pages.pop(i)
            if text is not None:
                out += page_step(known, i, text, json.loads(own), self._suppressed, self._labels)
            upcoming = i + 1
        if closed:
            for state in (self._clusters, self._waiting, self._next):
                state.clear()
        else:
            self._next.update((upcoming,))
            self._put(self._clusters, [tuple(c[n] for n in names) for c in known.clusters])
            self._put(self._waiting, [(i, t, o) for i, (t, o) in pages.items()])
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=_FIELDS)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:  # noqa: ANN001
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def start(pages: DataFrame, out: str, checkpoint: str, detector: Callable[[Column], Column], rules: DataFrame, *, most_rules: int = MOST_RULES):
    """Starts the stream over (doc_id, page_index, text); spans are appended to ``out``. Returns the query.

    More than ``most_rules`` rules are stored in a folder beside the checkpoint.

    ``detector`` gives a text's spans as an array of structs (label, text, norm_text, confidence, source, char_start, char_end).
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    edits = rules.where("kind in ('suppress', 'override')").select("kind", "norm_text", "label")
    held = edits.limit(most_rules + 1).collect()
    suppressed, labels = frozenset(r.norm_text for r in held if r.kind == "suppress"), {r.norm_text: r.label for r in held if r.kind == "override"}
    if len(held) > most_rules:
        suppressed = labels = store_rules(edits, f"{checkpoint.rstrip('/')}_rules/{uuid.uuid4().hex}")
    keyed = pages.select("doc_id", "page_index", "text", F.to_json(F.coalesce(detector(F.col("text")), F.array())).alias("own")).groupBy("doc_id")
    spans = keyed.transformWithStateInPandas(PageProcessor(suppressed, labels), STEP, "Append", "None")
    return spans.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
