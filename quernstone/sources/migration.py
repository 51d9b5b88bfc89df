"""Journalled migration of a published snapshot: planned, written, verified, switched; a run that was cut off goes on, or is rolled back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators.contracts import ContractError, logical_digest
from quernstone.sources.snapshots import _fs, _write_text, canonical_json, publish, read_text

PHASES = ("planned", "written", "verified", "switched")
Tables = Mapping[str, tuple[DataFrame, list[str]]]


class Migration:
    """Moves ``root``'s current build to a new form of its tables, named ``name``, beside a journal ``migration-<name>.json``.

    ``old`` names the tables that the build has; ``make`` gets them and returns the new ones (frame and sort keys); ``check`` gets both and
    raises ``ContractError`` where they disagree, for example where the old aggregates, made again from the new rows, aren't the
    published ones. Every phase is entered in the journal when it is done, in one rename:

    - planned: which build is left, and digests of its tables;
    - written: the new build, not yet current;
    - verified: the old build unchanged since, new tables as written, ``check`` passed;
    - switched: the pointer names the new build.

    ``run`` continues behind the last phase entered. Readers see the old build until the pointer changes, and the new one from then on.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, old: list[str], make: Callable[[dict[str, DataFrame]], Tables], check: Callable[[dict[str, DataFrame], dict[str, DataFrame]], None]):
        self.spark, self.root, self.name, self.old, self.make, self.check = spark, root.rstrip("/"), name, list(old), make, check
        self.path = f"{self.root}/migration-{name}.json"

    def journal(self) -> dict | None:
        fs, p = _fs(self.spark, self.path)
        return json.loads(read_text(self.spark, self.path)) if fs.exists(p) else None

    def _enter(self, phase: str, entry: dict) -> dict:
        entry = entry | {"phase": phase}
        _write_text(self.spark, self.path, canonical_json(entry))
        return entry

    def _tables(self, build: str, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.root}/{build}/{n}.parquet") for n in names}

    def _digests(self, build: str, names: list[str]) -> dict[str, str]:
        return {n: logical_digest(df) for n, df in self._tables(build, names).items()}

    def _current(self) -> str:
        return json.loads(read_text(self.spark, f"{self.root}/current.json"))["build"]

    def plan(self) -> dict:
        build = self._current()
        return self._enter("planned", {"run": uuid.uuid4().hex, "from": build, "old": self._digests(build, self.old)})

    def write(self, j: dict) -> dict:
        made = dict(self.make(self._tables(j["from"], self.old)))
        # published in a folder of its own: readers stay with the old build until the switch
        build = publish(self.spark, f"{self.root}/migration-{self.name}", made, {"migration": self.name, "from": j["from"], "old": canonical_json(j["old"])})
        return self._enter("written", j | {"to": build, "new": self._staged(build, sorted(made))})

    def _staged(self, build: str, names: list[str]) -> dict[str, str]:
        return {n: logical_digest(df) for n, df in self._new(build, names).items()}

    def _new(self, build: str, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.root}/migration-{self.name}/{build}/{n}.parquet") for n in names}

    def verify(self, j: dict) -> dict:
        if self._digests(j["from"], self.old) != j["old"]:
            raise ContractError("the old build has changed since the migration was planned")
        if self._staged(j["to"], sorted(j["new"])) != j["new"]:
            raise ContractError("the new build isn't what was written")
        self.check(self._tables(j["from"], self.old), self._new(j["to"], sorted(j["new"])))
        return self._enter("verified", j)

    def switch(self, j: dict) -> dict:
        if (now := self._current()) not in (j["from"], j["to"]):
            raise ContractError(f"build {now} was published while {j['from']} was being migrated")
        fs, source = _fs(self.spark, f"{self.root}/migration-{self.name}/{j['to']}")
        _, target = _fs(self.spark, f"{self.root}/{j['to']}")
        if not fs.exists(target) and not fs.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")
        _write_text(self.spark, f"{self.root}/current.json", canonical_json({"build": j["to"]}))
        return self._enter("switched", j)

    def run(self) -> str:
        """All phases that aren't entered yet; returns the build that is current then. A run behind a finished one does nothing."""
        j = self.journal() or self.plan()
        for phase, step in zip(PHASES[1:], (self.write, self.verify, self.switch), strict=True):
            if PHASES.index(j["phase"]) < PHASES.index(phase):
                j = step(j)
        return j["to"]

    def rollback(self) -> str:
        """Back to the old build, whatever phase was reached: the pointer first, then what was written goes, then the journal."""
        j = self.journal()
        if j is None:
            return self._current()
        if self._current() == j.get("to"):
            if self._digests(j["from"], self.old) != j["old"]:
                raise ContractError("the old build has changed: there is nothing to go back to")
            _write_text(self.spark, f"{self.root}/current.json", canonical_json({"build": j["from"]}))
        fs, staged = _fs(self.spark, f"{self.root}/migration-{self.name}")
        fs.delete(staged, True)
        if "to" in j:
            fs.delete(_fs(self.spark, f"{self.root}/{j['to']}")[1], True)
        fs.delete(_fs(self.spark, self.path)[1], False)
        return self._current()
