"""Contexts: described data that agents search and compute over, and the registry that keeps their results.

``search`` and ``compute`` are plan nodes like any other: the agent is asked when a plan with them runs,
once for each context, and what it answered joins the context's description and the registry.
Before a computation is planned, the registry is searched for earlier contexts that may help it.
"""

from __future__ import annotations

import datetime
import functools
import re
import urllib.parse
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dataset import Dataset
from .operators.provider import hashed_vector
from .plans import logical
from .shared import exists
from .types import field, hash_for_id


class ContextNotFoundError(KeyError):
    pass


class AgentProvider:
    """Answers a search or computation over a context with the tools that it offers."""

    def search(self, description: str, tools: dict[str, Callable], query: str) -> str:
        raise NotImplementedError

    def compute(self, description: str, tools: dict[str, Callable], instruction: str, additional_contexts: list["Context"]) -> str:
        raise NotImplementedError

    def lookup(self, instruction: str) -> str:
        """What to search the registry for before this computation."""
        return instruction


class LocalAgent(AgentProvider):
    """Deterministic: the passages of listed files with a query's words, or the answer of a rule for the instruction."""

    def __init__(self, rules: dict[str, Callable[[dict[str, Callable]], Any]] | None = None):
        self.rules = rules or {}

    def search(self, description, tools, query):
        if query in self.rules:
            return str(self.rules[query](tools))
        words = sorted({w.lower() for w in query.split() if len(w) > 3})
        found = tools["tool_find_filepaths"](words) if words and "tool_find_filepaths" in tools else []
        return ", ".join(found) or "nothing found"

    def compute(self, description, tools, instruction, additional_contexts):
        if instruction in self.rules:
            return str(self.rules[instruction](tools))
        return self.search(description, tools, instruction)


class Context(Dataset):
    """A root dataset of one row: what the data is. Methods named ``tool_*`` are what agents may use."""

    def __init__(self, id: str, description: str, schema: T.StructType | None = None, materialized: bool = False, parent: "Context | None" = None, node: logical.Node | None = None):
        self._description, self._materialized = description, materialized
        self.parent = parent
        self.history: list[tuple[str, str]] = list(parent.history) if parent else []
        shape = schema or T.StructType([field("context", str, "the context's description")])
        super().__init__(node or logical.make("context_scan", (), shape, source=_ContextSource(self, id)), id)

    @property
    def description(self) -> str:
        return self._description

    @property
    def materialized(self) -> bool:
        return self._materialized

    def set_description(self, description: str) -> None:
        self._description = description

    def set_materialized(self, materialized: bool) -> None:
        self._materialized = materialized

    def tools(self) -> dict[str, Callable]:
        own = {n: getattr(self, n) for n in dir(self) if n.startswith("tool_") and callable(getattr(self, n))}
        return (self.parent.tools() if self.parent else {}) | own

    def values(self) -> dict[str, str]:
        return {"context": self.description}

    def search(self, query: str, agent: AgentProvider | None = None, manager: "ContextManager | None" = None) -> "Context":
        """A context whose description has the answer appended once it ran."""
        return _Asked("search", self, query, agent, manager)

    def compute(self, instruction: str, agent: AgentProvider | None = None, manager: "ContextManager | None" = None) -> "Context":
        """A context with a new column ``result-{id}``; the nearest earlier context is given to the agent too."""
        return _Asked("compute", self, instruction, agent, manager)

    def load(self, spark: SparkSession) -> DataFrame:
        values = self.values()
        return spark.createDataFrame([tuple(values.get(n) for n in self.schema.names)], self.schema)

    def __str__(self) -> str:
        return f"Context({self.id}, {self.description[:60]!r}, materialized={self.materialized})"


class _ContextSource:
    def __init__(self, context: Context, id: str):
        self.context, self.id = context, id

    def load(self, spark: SparkSession) -> DataFrame:
        return self.context.load(spark)

    def __repr__(self) -> str:
        return f"ContextSource({self.id})"


class _Asked(Context):
    """A search or computation over a context: not asked before a plan with it runs, and then once."""

    def __init__(self, kind: str, parent: Context, asked: str, agent: AgentProvider | None, manager: "ContextManager | None"):
        self.kind, self.asked, self.agent = kind, asked, agent or LocalAgent()
        self.manager = manager or ContextManager.shared()
        self.answer: str | None = None
        id = hash_for_id(f"{parent.id}|{kind}|{asked}")
        self.column = f"result-{id}"
        shape = parent.schema if kind == "search" else T.StructType([*parent.schema.fields, field(self.column, str, "the agent's answer")])
        super().__init__(id, parent.description, shape, False, parent, logical.make(kind, (parent.node,), shape, context=self, context_id=parent.id, asked=asked))

    def related(self, k: int = 1) -> list[Context]:
        """Earlier contexts that may help, by what the agent would look up."""
        found = self.manager.search_context(self.agent.lookup(self.asked), k=k + 2, where={"materialized": True})
        return [c for c in found if c.id not in (self.id, self.parent.id)][:k]

    def evaluate(self, related: list[Context]) -> None:
        """Ask the agent, unless it was asked before; the parent has been."""
        if self.answer is not None:
            return
        if self.kind == "search":
            self.answer = self.agent.search(self.parent.description, self.parent.tools(), self.asked)
        else:
            self.answer = self.agent.compute(self.parent.description, self.parent.tools(), self.asked, related)
        self.set_description(f"{self.parent.description}\n\nRESULT: {self.answer}")
        self.set_materialized(True)
        self.history = [*self.parent.history, (f"{self.kind}: {self.asked}", self.answer)]
        self.manager.add_context(self, update=True)

    def values(self):
        own = {"context": self.description}
        return self.parent.values() | (own if self.kind == "search" else {self.column: self.answer})


def _plain(path: str) -> str:
    """A file's path without the scheme that stands for this machine."""
    return re.sub(r"^file:/+", "/", path)


class TextFileContext(Context):
    """A tree of text files; agents list and read them, or run semantic operators over them."""

    def __init__(self, path: str, id: str, description: str):
        self.path = path
        super().__init__(id, description)

    def _spark(self) -> SparkSession:
        return SparkSession.builder.getOrCreate()

    def tool_list_filepaths(self) -> list[str]:
        """All files of the tree but hidden ones, such as the checksums that file systems keep; names only, listed by Spark."""
        files = self._spark().read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path)
        return sorted(_plain(urllib.parse.unquote(f)) for f in files.inputFiles())

    def tool_read_filepath(self, path: str) -> str:
        return self._spark().read.text(path, wholetext=True).first()[0]

    def tool_find_filepaths(self, words: list[str]) -> list[str]:
        """Files with any of the lower-case words, found by a job over all of them."""
        files = self._spark().read.option("recursiveFileLookup", "true").text(self.path, wholetext=True)
        text = F.lower("value")
        hit = functools.reduce(lambda a, b: a | b, (text.contains(w) for w in words))
        return sorted(_plain(urllib.parse.unquote(r[0])) for r in files.where(hit).select("_metadata.file_path").collect())

    def tool_execute_semantic_operators(self, instruction: str, provider=None) -> list[str]:
        """Names of the files that meet an instruction."""
        from .sources import TextFileDataset

        return [r["filename"] for r in TextFileDataset(self.id, self.path).sem_filter(instruction).run(provider=provider)]


_STORED = "id string, description string, materialized boolean, vector array<double>, written timestamp"


class ContextManager:
    """Contexts by id, with a vector of each description; with a folder, they are a table there that other sessions read.

    A changed context is a further row of the table, and the last one counts. Searches are one job over the
    table, of which the k nearest rows come back, beside this session's own contexts.
    """

    _shared: "ContextManager | None" = None

    def __init__(self, folder: str | None = None):
        self.table = f"{folder.rstrip('/')}/contexts" if folder else None
        self.contexts: dict[str, Context] = {}
        self.vectors: dict[str, np.ndarray] = {}

    @classmethod
    def shared(cls) -> "ContextManager":
        cls._shared = cls._shared or cls()
        return cls._shared

    def add_context(self, context: Context, update: bool = False) -> None:
        if context.id in self.contexts and not update:
            return
        self.contexts[context.id] = context
        self.vectors[context.id] = hashed_vector(context.description)
        if self.table:
            row = (context.id, context.description, context.materialized, self.vectors[context.id].tolist(), datetime.datetime.now())
            SparkSession.builder.getOrCreate().createDataFrame([row], _STORED).coalesce(1).write.mode("append").parquet(self.table)

    def update_context(self, id: str, description: str, materialized: bool = True) -> None:
        context = self.get_context(id)
        context.set_description(description)
        context.set_materialized(materialized)
        self.add_context(context, update=True)

    def _stored(self) -> DataFrame | None:
        """The table's last row of each id that this session doesn't hold."""
        spark = SparkSession.builder.getOrCreate()
        if not self.table or not exists(spark, self.table):
            return None
        rows = spark.read.schema(_STORED).parquet(self.table)
        last = rows.groupBy("id").agg(F.max_by(F.struct("description", "materialized", "vector"), "written").alias("last")).select("id", "last.*")
        return last.where(~F.col("id").isin(list(self.contexts))) if self.contexts else last

    def _restored(self, row) -> Context:
        context = Context(row["id"], row["description"], None, row["materialized"])
        self.contexts[context.id], self.vectors[context.id] = context, hashed_vector(context.description)
        return context

    def get_context(self, id: str) -> Context:
        if id in self.contexts:
            return self.contexts[id]
        stored = self._stored()
        row = stored.where(F.col("id") == id).first() if stored is not None else None
        if row is None:
            raise ContextNotFoundError(id)
        return self._restored(row)

    def search_context(self, query: str, k: int = 1, where: dict | None = None) -> list[Context]:
        """The k contexts whose descriptions are nearest to the query, of those with the given properties."""
        q = hashed_vector(query)
        stored = self._stored()
        if stored is not None:
            for name, value in (where or {}).items():
                stored = stored.where(F.col(name) == value)
            like = F.aggregate(F.zip_with("vector", F.array(*map(F.lit, q.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            for row in stored.orderBy(like.desc(), "id").limit(k).collect():
                self._restored(row)
        fitting = [c for c in self.contexts.values() if all(getattr(c, n) == v for n, v in (where or {}).items())]
        return sorted(fitting, key=lambda c: (-float(self.vectors[c.id] @ q), c.id))[:k]
