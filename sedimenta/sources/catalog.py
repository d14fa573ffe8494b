"""Sources, their additive schema histories and inputs, declared by YAML manifests.

A manifest holds the whole known history of one source.  Applying it keeps all identities given before; what was declared once can't
be changed, only added to, and the active versions can move.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, replace
from typing import Any

import yaml

from ..errors import EngineError
from ..types import DECLARABLE, Field, Logical, with_system
from . import pointer

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
FORMATS = ("RFC3339", "UNIX_MILLISECONDS")
#: Counts at most: schemas and fields, inputs, profiles of an input, mappings.
LIMITS = {"schemas": 1000, "fields": 1000, "inputs": 100, "ingestion_profile_revisions": 1000, "mappings": 1000}


@dataclass(frozen=True)
class Schema:
    version: int
    id: str
    fields: tuple[Field, ...]

    @property
    def all_fields(self) -> list[Field]:
        return with_system(list(self.fields))


@dataclass(frozen=True)
class Profile:
    """mappings: (target field, JSON pointer)"""

    revision: int
    id: str
    target: int
    most_bytes: int
    time_pointer: str
    time_format: str
    mappings: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Input:
    name: str
    id: str
    active: int
    profiles: tuple[Profile, ...]

    def profile(self, revision: int | None = None) -> Profile:
        return next(p for p in self.profiles if p.revision == (self.active if revision is None else revision))


@dataclass(frozen=True)
class SourceDefinition:
    name: str
    id: str
    display_name: str
    active: int
    schemas: tuple[Schema, ...]
    inputs: tuple[Input, ...]

    def schema(self, version: int | None = None) -> Schema:
        return next(s for s in self.schemas if s.version == (self.active if version is None else version))

    def input(self, name: str) -> Input:
        found = next((i for i in self.inputs if i.name == name), None)
        if found is None:
            raise EngineError("INPUT_NOT_FOUND", name)
        return found


def invalid(message: str):
    raise EngineError("CATALOG_MANIFEST_INVALID", message)


class Loader(yaml.SafeLoader):
    """YAML without aliases, tags of its own or repeated keys."""

    def compose_node(self, parent, index):
        if self.check_event(yaml.events.AliasEvent):
            invalid("aliases are not allowed")
        event = self.peek_event()
        if getattr(event, "tag", None):
            invalid("explicit tags are not allowed")
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len({repr(k) for k in keys}) != len(keys):
            invalid("a key is repeated")
        return super().construct_mapping(node, deep)


def load_yaml(text: str) -> Any:
    if (version := re.search(r"^%YAML\s+(\S+)", text, re.M)) and version[1] != "1.2":
        invalid("only YAML 1.2 is read")
    text = re.sub(r"^%YAML\s+1\.2", "%YAML 1.1", text, flags=re.M)  # the reader knows it by this name
    try:
        documents = list(yaml.load_all(text, Loader))
    except yaml.YAMLError as error:
        invalid(str(error))
    if len(documents) != 1:
        invalid("one document is needed")
    return documents[0]


class Reader:
    """Takes the properties of one mapping; what is left over is unknown."""

    def __init__(self, value: Any, where: str):
        if not isinstance(value, dict):
            invalid(f"{where} must be a mapping")
        self.left, self.where = dict(value), where

    def get(self, key: str, kind: type, optional: bool = False) -> Any:
        if key not in self.left:
            return None if optional else invalid(f"{self.where}.{key} is missing")
        value = self.left.pop(key)
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            invalid(f"{self.where}.{key} must be of type {kind.__name__}")
        if isinstance(value, list) and len(value) > LIMITS.get(key, len(value)):
            invalid(f"{self.where}.{key} has over {LIMITS[key]} entries")
        return value

    def name(self, key: str) -> str:
        value = self.get(key, str)
        return value if NAME.fullmatch(value) else invalid(f"{self.where}.{key} is not a name")

    def number(self, key: str) -> int:
        value = self.get(key, int)
        return value if value > 0 else invalid(f"{self.where}.{key} must be positive")

    def end(self) -> None:
        if self.left:
            invalid(f"{self.where} has unknown properties: {', '.join(map(str, self.left))}")


def once(values: list, what: str) -> None:
    if len(set(values)) != len(values):
        invalid(f"{what} is repeated")


def valid_pointer(value: str, where: str) -> str:
    return value if pointer.tokens(value) is not None else invalid(f"{where} is not a JSON pointer")


def read_field(value: Any, where: str) -> Field:
    r = Reader(value, where)
    name, kind = r.name("name"), r.get("logical_type", str)
    if kind not in {t.value for t in DECLARABLE}:
        invalid(f"{where}.logical_type is unknown")
    nullability = r.get("nullability", str)
    if nullability not in ("NULLABLE", "NON_NULL"):
        invalid(f"{where}.nullability is unknown")
    at = r.get("historical_remainder_pointer", str, True)
    if at is not None:
        valid_pointer(at, where)
        if nullability != "NULLABLE":
            invalid(f"{where}: only a nullable field can be read from history")
    description = r.get("description", str, True)
    r.end()
    return Field(name, Logical(kind), nullability == "NULLABLE", None, at, description)


def read_manifest(text: str) -> SourceDefinition:
    """A valid manifest without identities."""
    top = Reader(load_yaml(text), "manifest")
    if top.get("format_version", int) != 1:
        invalid("format_version must be 1")
    r = Reader(top.get("source", dict), "source")
    top.end()
    name, shown, active = r.name("name"), r.get("display_name", str, True), r.number("active_schema_version")
    schemas = []
    for i, value in enumerate(r.get("schemas", list)):
        s = Reader(value, f"schemas[{i}]")
        version = s.number("version")
        fields = tuple(read_field(f, f"schemas[{i}].fields[{j}]") for j, f in enumerate(s.get("fields", list)))
        s.end()
        once([f.name for f in fields], f"a field name in schema {version}")
        schemas.append(Schema(version, "", fields))
    once([s.version for s in schemas], "a schema version")
    schemas.sort(key=lambda s: s.version)
    if active not in {s.version for s in schemas}:
        invalid("active_schema_version is not declared")
    for old, new in zip(schemas, schemas[1:], strict=False):
        check_additive(old, new)
    inputs = tuple(read_input(v, f"inputs[{i}]", schemas) for i, v in enumerate(r.get("inputs", list, True) or []))
    once([i.name for i in inputs], "an input name")
    r.end()
    return SourceDefinition(name, "", shown or name, active, tuple(schemas), inputs)


def check_additive(old: Schema, new: Schema) -> None:
    strip = lambda f: replace(f, id=None, description=None)
    kept, added = new.fields[: len(old.fields)], new.fields[len(old.fields) :]
    if [strip(f) for f in kept] != [strip(f) for f in old.fields] or not all(f.nullable for f in added):
        raise EngineError("CATALOG_SCHEMA_INCOMPATIBLE", f"version {new.version} may only append nullable fields to version {old.version}")


def read_input(value: Any, where: str, schemas: list[Schema]) -> Input:
    r = Reader(value, where)
    name, active, profiles = r.name("name"), r.number("active_ingestion_profile_revision"), []
    for i, p in enumerate(r.get("ingestion_profile_revisions", list)):
        at = f"{where}.ingestion_profile_revisions[{i}]"
        q = Reader(p, at)
        revision, target, most = q.number("revision"), q.number("target_schema_version"), q.number("maximum_record_bytes")
        t = Reader(q.get("event_time", dict), f"{at}.event_time")
        time_pointer, time_format = valid_pointer(t.get("json_pointer", str), at), t.get("format", str)
        t.end()
        if time_format not in FORMATS:
            invalid(f"{at}.event_time.format is unknown")
        mappings = []
        for j, m in enumerate(q.get("mappings", list)):
            x = Reader(m, f"{at}.mappings[{j}]")
            mappings.append((x.name("target_field"), valid_pointer(x.get("json_pointer", str), at)))
            x.end()
        q.end()
        once([m[0] for m in mappings], "a mapped field")
        schema = next((s for s in schemas if s.version == target), None)
        if schema is None:
            invalid(f"{at}: schema {target} is not declared")
        known = {f.name for f in schema.fields}
        if not {m[0] for m in mappings} <= known:
            raise EngineError("CATALOG_PROFILE_INVALID", f"{at} maps a field that schema {target} hasn't")
        if not {f.name for f in schema.fields if not f.nullable} <= {m[0] for m in mappings}:
            raise EngineError("CATALOG_PROFILE_INVALID", f"{at} leaves a required field without a mapping")
        profiles.append(Profile(revision, "", target, most, time_pointer, time_format, tuple(mappings)))
    r.end()
    once([p.revision for p in profiles], "a profile revision")
    if active not in {p.revision for p in profiles}:
        invalid(f"{where}: the active revision is not declared")
    return Input(name, "", active, tuple(sorted(profiles, key=lambda p: p.revision)))


def new_id() -> str:
    return str(uuid.uuid4())


def applied(new: SourceDefinition, old: SourceDefinition | None) -> tuple[SourceDefinition, str]:
    """The definition with identities, and CREATED, UPDATED or UNCHANGED."""
    ids = {f.name: f.id for s in old.schemas for f in s.fields} if old else {}
    for s in new.schemas:
        for f in s.fields:
            ids.setdefault(f.name, new_id())
    before = {s.version: s for s in old.schemas} if old else {}
    schemas = []
    for s in new.schemas:
        fields = tuple(replace(f, id=ids[f.name]) for f in s.fields)
        known = before.pop(s.version, None)
        if known and known.fields != fields:
            raise EngineError("CATALOG_DEFINITION_CONFLICT", f"schema {s.version} is declared otherwise already")
        schemas.append(known or Schema(s.version, new_id(), fields))
    if before:
        raise EngineError("CATALOG_DEFINITION_CONFLICT", f"schema {min(before)} is missing")
    inputs_before = {i.name: i for i in old.inputs} if old else {}
    inputs = []
    for i in new.inputs:
        known = inputs_before.pop(i.name, None)
        profiles_before = {p.revision: p for p in known.profiles} if known else {}
        profiles = []
        for p in i.profiles:
            same = profiles_before.pop(p.revision, None)
            if same and replace(same, id="") != p:
                raise EngineError("CATALOG_DEFINITION_CONFLICT", f"profile {i.name}/{p.revision} is declared otherwise already")
            profiles.append(same or replace(p, id=new_id()))
        if profiles_before:
            raise EngineError("CATALOG_DEFINITION_CONFLICT", f"profile {i.name}/{min(profiles_before)} is missing")
        inputs.append(Input(i.name, known.id if known else new_id(), i.active, tuple(profiles)))
    if inputs_before:
        raise EngineError("CATALOG_DEFINITION_CONFLICT", f"input {min(inputs_before)} is missing")
    out = SourceDefinition(new.name, old.id if old else new_id(), new.display_name, new.active, tuple(schemas), tuple(inputs))
    return out, "CREATED" if old is None else "UNCHANGED" if out == old else "UPDATED"


# as plain values, for the manifest of the store


def to_plain(d: SourceDefinition) -> dict:
    field = lambda f: {"name": f.name, "type": f.type.value, "nullable": f.nullable, "id": f.id, "pointer": f.pointer, "description": f.description}
    return {
        "name": d.name, "id": d.id, "display_name": d.display_name, "active": d.active,
        "schemas": [{"version": s.version, "id": s.id, "fields": [field(f) for f in s.fields]} for s in d.schemas],
        "inputs": [{"name": i.name, "id": i.id, "active": i.active, "profiles": [{**p.__dict__, "mappings": [list(m) for m in p.mappings]} for p in i.profiles]} for i in d.inputs],
    }


def from_plain(x: dict) -> SourceDefinition:
    try:
        schemas = tuple(Schema(s["version"], s["id"], tuple(Field(**{**f, "type": Logical(f["type"])}) for f in s["fields"])) for s in x["schemas"])
        inputs = tuple(Input(i["name"], i["id"], i["active"], tuple(Profile(**{**p, "mappings": tuple(map(tuple, p["mappings"]))}) for p in i["profiles"])) for i in x["inputs"])
        return SourceDefinition(x["name"], x["id"], x["display_name"], x["active"], schemas, inputs)
    except (KeyError, TypeError, ValueError) as error:
        raise EngineError("CATALOG_CORRUPT", str(error)) from error
