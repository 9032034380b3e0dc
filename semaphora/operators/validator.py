"""The validator: every rule is an expression over one nested row (doc, scene) and gives an array of issues (code,
severity, element_id, path). All rules of a document are one projection: nothing is joined or shuffled, so documents
that arrive as a stream are validated by the same call.

Look-ups by id take the last of equal ids; issues are reported by list position. Look-ups are bound once a document
(judged()), ids are grouped by sorting and compared by array_except, so that a document of thousands of elements stays
cheap; only a look-up in a map goes through the map's keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..scene import LISTS, SCENE, STATES, field, let, path_key, path_of, position_of
from .documents import shape_problems

ISSUE = ["doc", "code", "severity", "element_id", "path"]
FOUND = "array<struct<code:string,severity:string,element_id:string,path:string>>"
_SHORT = {path: path.split("/")[-1] for path in LISTS}


def _at(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _issue(code: str, element: Column, path: Column) -> Column:
    severity = "warning" if code in rules.WARNINGS else "error"
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), element.alias("element_id"), path.alias("path"))


def _none() -> Column:
    return F.array().cast(FOUND)


def _ids(items: Column | str) -> Column:
    return F.transform(items, lambda x: x["id"])


def _runs(keys: Column) -> Column:
    """(key, first: its first position, n: how often it stands there, last: its last position) of each distinct key.

    Sorted once, so that a list of thousands costs no square of its length; nulls are no keys."""

    def cut(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1)["key"] != x["key"]), k)), lambda k: k.isNotNull())

        def run(b: Column) -> Column:
            end = lambda j: F.coalesce(F.get(b, j + 1), F.size(s)) - 1
            of = lambda k, j: F.struct(F.get(s, k)["key"].alias("key"), F.get(s, k)["at"].alias("first"), (end(j) - k + 1).alias("n"), F.get(s, end(j))["at"].alias("last"))
            return F.transform(b, of)

        return let(begins, run)

    placed = F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at")))
    return let(F.sort_array(F.filter(placed, lambda x: x["key"].isNotNull())), cut)


def _all_differ(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) == F.size(keys)


def _map_of_last(items: Column, value: Callable[[Column], Column]) -> Column:
    """id -> value of the last element of that id. Ids are sorted only where some are equal."""
    last = lambda r: F.map_from_arrays(F.transform(r, lambda x: x["key"]), F.transform(r, lambda x: value(F.get(items, x["last"]))))
    return let(_ids(items), lambda ids: F.when(_all_differ(ids), F.map_from_arrays(ids, F.transform(items, value))).otherwise(let(_runs(ids), last)))


def _repeated(keys: Column) -> Column:
    """First positions of the keys that stand there more than once, ascending."""
    firsts = lambda k: F.sort_array(F.transform(F.filter(_runs(k), lambda r: r["n"] > 1), lambda r: r["first"]))
    return let(keys, lambda k: F.when(_all_differ(k), F.array().cast("array<int>")).otherwise(firsts(k)))


def _end(e: Column, i: Column, x: str) -> Column:
    """An end of an edge; paths are put together for issues only, since few elements have one."""
    return F.struct(i.alias("i"), F.lit(x).alias("end"), e["id"].alias("id"), e[x]["node"].alias("node"), e[x]["port"].alias("port"))


def _end_path(e: Column) -> Column:
    return _at("topology/edges/", e["i"], "/", e["end"])


def _track(e: Column) -> Column:
    return F.struct(e["a"].alias("a"), e["b"].alias("b"))


def _looked_up(scene: Column) -> dict[str, Column]:
    """What rules look up in a scene, by name."""
    lists = {name: field(scene, path) for path, name in _SHORT.items()}
    keys = {f"state_{n}": F.coalesce(F.map_keys(scene["state"][n]), F.array().cast("array<string>")) for n in STATES}
    return {
        **lists,
        **{f"{name}_ids": _ids(items) for name, items in lists.items()},
        **keys,
        "scene": scene,
        "ends": F.flatten(F.transform(lists["edges"], lambda e, i: F.array(_end(e, i, "a"), _end(e, i, "b")))),
        "kinds": _map_of_last(lists["nodes"], lambda n: n["kind"]),
        "tracks": _map_of_last(lists["edges"], _track),
        "heads": _map_of_last(lists["signals"], lambda s: s["at"]),
        "degrees": let(_runs(F.flatten(F.transform(lists["edges"], lambda e: F.array(e["a"]["node"], e["b"]["node"])))), lambda r: F.map_from_arrays(F.transform(r, lambda x: x["key"]), F.transform(r, lambda x: x["n"]))),
    }


def judged(scene: Column, *names: str) -> Column:
    """The issues of some rules, in the order of names.

    Whatever the rules look up is computed once a document: it is bound before them, since the optimizer would put a
    column's expression into the lambdas that name it, to be computed again for every element."""
    needs = list(dict.fromkeys(n for name in names for n in RULES[name][1].split()))
    every = _looked_up(scene)
    return let(F.struct(*(every[n].alias(n) for n in needs)), lambda x: F.concat(*(RULES[n][0](x) for n in names)))


def rule1_duplicate_ids(x: Column) -> Column:
    of = lambda path, name: F.transform(x[name], lambda e, i: F.struct(e["id"].alias("id"), _at(path + "/", i).alias("path")))
    every = F.concat(*(of(path, name) for path, name in _SHORT.items()))
    issues = lambda firsts: let(every, lambda ids: F.transform(firsts, lambda k: _issue("ID_DUPLICATE", F.get(ids, k)["id"], F.get(ids, k)["path"])))
    return let(_repeated(F.concat(*(x[f"{n}_ids"] for n in _SHORT.values()))), lambda firsts: F.when(F.size(firsts) > 0, issues(firsts)).otherwise(_none()))


def _unknown(refs: Column, among: Column) -> Column:
    return F.array_except(refs, among)


def _dangling(placed: Column, ref: str, among: Column, path: Callable[[Column], Column]) -> Column:
    """An issue for each of placed (id, ref and what path needs) whose ref is not among ids."""
    issues = lambda unknown: F.transform(F.filter(placed, lambda e: F.array_contains(unknown, e[ref])), lambda e: _issue("TOPO_DANGLING_REF", e["id"], path(e)))
    return let(_unknown(F.transform(placed, lambda e: e[ref]), among), lambda unknown: F.when(F.size(unknown) > 0, issues(unknown)).otherwise(_none()))


def rule2_edge_references(x: Column) -> Column:
    return _dangling(x["ends"], "node", x["nodes_ids"], _end_path)


def rule2_attachments(x: Column) -> Column:
    def of(name: str) -> Column:
        placed = F.transform(x[name], lambda e, i: F.struct(e["id"].alias("id"), e["at"]["edge"].alias("edge"), i.alias("i")))
        return let(placed, lambda p: _dangling(p, "edge", x["edges_ids"], lambda e: _at(name + "/", e["i"], "/at/edge")))

    return F.concat(of("signals"), of("derailers"))


def rule3_ports(x: Column) -> Column:
    allowed = [f"{k}|{p}" for k, ports in rules.PORTS.items() for p in ports]  # a set by hash, not a list to go through
    bad = lambda e: ~F.coalesce(F.concat(F.try_element_at(x["kinds"], e["node"]), F.lit("|"), e["port"]).isin(allowed), F.lit(True))
    return F.transform(F.filter(x["ends"], bad), lambda e: _issue("TOPO_PORT_UNKNOWN", e["id"], _end_path(e)))


def rule4_port_twice(x: Column) -> Column:
    keys = F.transform(x["ends"], lambda e: F.concat(e["node"], F.lit("/"), e["port"]))
    issue = lambda e: _issue("TOPO_PORT_DUP", e["node"], _at("topology/nodes/", e["node"], "/", e["port"]))
    return F.transform(_repeated(keys), lambda k: issue(F.get(x["ends"], k)))


def _listed(items: Column, path: str, tail: str, code: str, bad: Callable[[Column], Column]) -> Column:
    """An issue for each element of a list that is bad."""
    placed = F.transform(items, lambda x, i: F.struct(bad(x).alias("bad"), x["id"].alias("id"), i.alias("i")))
    return F.transform(F.filter(placed, lambda x: x["bad"]), lambda x: _issue(code, x["id"], _at(path + "/", x["i"], tail)))


def rule5_self_loops(x: Column) -> Column:
    return _listed(x["edges"], "topology/edges", "", "TOPO_SELF_LOOP", lambda e: e["a"]["node"] == e["b"]["node"])


def rule6_degree(x: Column) -> Column:
    wanted = F.create_map(*(F.lit(v) for k in rules.PORTS for v in (k, rules.degree(k))))
    degree = lambda n: F.coalesce(F.try_element_at(x["degrees"], n["id"]), F.lit(0))
    return _listed(x["nodes"], "topology/nodes", "", "TOPO_DEGREE", lambda n: degree(n) != F.element_at(wanted, n["kind"]))


def rule7_half_labels(x: Column) -> Column:
    return _listed(x["nodes"], "topology/nodes", "/half_labels", "NODE_HALF_LABELS_UNEXPECTED", lambda n: (F.coalesce(F.size(n["half_labels"]), F.lit(0)) > 0) & ~n["kind"].isin(rules.SLIPS))


def out_of_bounds(geometry: Column, width: Column, height: Column) -> Column:
    """The first of bbox, polyline, point with a coordinate outside 0 to width and 0 to height, both inclusive."""
    inside = lambda x, y: (x >= 0) & (x <= width) & (y >= 0) & (y <= height)
    xy = lambda p, k=0: inside(F.get(p, F.lit(k)), F.get(p, F.lit(k + 1)))
    box, line, point = geometry["bbox"], geometry["polyline"], geometry["point"]
    return F.when(box.isNotNull() & ~(xy(box) & xy(box, 2)), "bbox").when(F.exists(line, lambda p: ~xy(p)), "polyline").when(point.isNotNull() & ~xy(point), "point")


def rule8_geometry(x: Column) -> Column:
    source = x["scene"]["source"]

    def of(path: str, name: str) -> Column:
        out = lambda e: out_of_bounds(e["geometry"], source["width"], source["height"])
        placed = F.transform(x[name], lambda e, i: F.struct(out(e).alias("field"), e["id"].alias("id"), i.alias("i")))
        bad = F.filter(placed, lambda e: e["field"].isNotNull())
        return F.transform(bad, lambda e: _issue("GEOM_OUT_OF_BOUNDS", e["id"], _at(path + "/", e["i"], "/geometry/", e["field"])))

    return F.concat(*(of(p, n) for p, n in _SHORT.items() if n != "routes"))


#: State family -> the list that its keys may name.
_STATED = {"switches": "nodes", "signals": "signals", "tracks": "edges", "derailers": "derailers", "routes": "routes"}


def rule9_state_keys(x: Column) -> Column:
    issue = lambda f: lambda k: _issue("STATE_UNKNOWN_ELEMENT", k, _at(f"state/{f}/", k))
    return F.concat(*(F.transform(_unknown(x[f"state_{f}"], x[f"{name}_ids"]), issue(f)) for f, name in _STATED.items()))


def rule14_missing_states(x: Column) -> Column:
    def of(f: str, name: str) -> Column:
        ids = _ids(F.filter(x["nodes"], lambda n: n["kind"].isin(rules.SWITCHING))) if f == "switches" else x[f"{name}_ids"]
        issue = lambda i: _issue("STATE_MISSING", i, _at(f"state/{f}/", i))
        again = lambda missing: F.transform(F.filter(ids, lambda i: F.array_contains(missing, i)), issue)  # noqa: E731  an issue for each row of a list
        return let(_unknown(ids, x[f"state_{f}"]), lambda missing: F.when(F.size(missing) > 0, again(missing)).otherwise(_none()))

    return F.concat(*(of(f, name) for f, name in _STATED.items()))


def _switch_states(x: Column) -> Column:
    """(id, kind, state) of the switch states whose node is known."""
    none = F.array().cast("array<struct<key:string,value:struct<position:string,active_paths:array<array<string>>,raw:string,confidence:double>>>")
    entries = F.coalesce(F.map_entries(x["scene"]["state"]["switches"]), none)
    rows = F.transform(entries, lambda e: F.struct(e["key"].alias("id"), F.try_element_at(x["kinds"], e["key"]).alias("kind"), e["value"].alias("s")))
    return F.filter(rows, lambda e: e["kind"].isNotNull())


def rule10_state_fields(x: Column) -> Column:
    """A node that isn't switching has no switch state; a switch has no paths, a slip no position."""
    field_ = lambda e: F.when(~e["kind"].isin(rules.SWITCHING), "").when((e["kind"] == "switch") & e["s"]["active_paths"].isNotNull(), "/active_paths").when((e["kind"] != "switch") & e["s"]["position"].isNotNull(), "/position")
    rows = F.filter(F.transform(_switch_states(x), lambda e: F.struct(e["id"].alias("id"), field_(e).alias("field"))), lambda e: e["field"].isNotNull())
    return F.transform(rows, lambda e: _issue("STATE_WRONG_FIELD_FOR_KIND", e["id"], _at("state/switches/", e["id"], e["field"])))


def path_set_allowed(kind: Column, paths: Column) -> Column:
    """Whether an array of path keys can be set at once in a node of the kind: allowed paths, no port twice, one family."""
    ports = F.flatten(F.transform(paths, lambda p: F.split(p, "-")))
    apart = F.size(ports) == F.size(F.array_distinct(ports))
    ok = F.lit(False)
    for k, families in rules.FAMILIES.items():
        fits = [F.size(F.array_except(paths, F.array(*map(F.lit, f)))) == 0 for f in families]
        any_ = fits[0]
        for f in fits[1:]:
            any_ = any_ | f
        ok = F.when(kind == k, any_).otherwise(ok)
    return (F.size(paths) == 0) | (apart & ok)


def rule11_path_sets(x: Column) -> Column:
    """Slips only: other kinds have no path sets, which rule 10 reports."""
    bad = lambda e: e["kind"].isin(rules.SLIPS) & e["s"]["active_paths"].isNotNull() & ~path_set_allowed(e["kind"], F.transform(e["s"]["active_paths"], path_key))
    return F.transform(F.filter(_switch_states(x), bad), lambda e: _issue("STATE_PATH_NOT_ALLOWED", e["id"], _at("state/switches/", e["id"], "/active_paths")))


def _settings(route: Column) -> Column:
    return F.coalesce(route["switch_positions"], F.create_map().cast("map<string,string>"))


def rule12_route_references(x: Column) -> Column:
    """References of routes, rules 2 and 12."""

    def of(r: Column, i: Column) -> Column:
        at = lambda *tail: _at("routes/", i, *tail)
        one = lambda code, path: F.array(_issue(code, r["id"], path))
        in_ = lambda name, id_: F.array_contains(x[f"{name}_ids"], id_)
        anywhere = in_("nodes", r["start"]) | in_("edges", r["start"]) | in_("signals", r["start"]) | in_("derailers", r["start"]) | in_("routes", r["start"])
        start = F.when(~anywhere, one("TOPO_DANGLING_REF", at("/start"))).when(~in_("signals", r["start"]), one("ROUTE_START_NOT_SIGNAL", at("/start"))).otherwise(_none())
        end = F.when(in_("signals", r["end"]) | in_("nodes", r["end"]), _none()).otherwise(one("TOPO_DANGLING_REF", at("/end")))
        path = F.transform(r["path"], lambda e, k: F.struct(r["id"].alias("id"), e.alias("edge"), k.alias("k")))
        keys = F.transform(_unknown(F.map_keys(_settings(r)), x["nodes_ids"]), lambda k: _issue("TOPO_DANGLING_REF", r["id"], at("/switch_positions/", k)))
        return F.concat(start, end, _dangling(path, "edge", x["edges_ids"], lambda e: at("/path/", e["k"])), keys)

    return F.flatten(F.transform(x["routes"], of))


_ALLOWED = {f"{k}|{p}": rules.expected_setting(k, p) or "" for k, paths in rules.PATHS.items() for p in paths}


def _walk(x: Column, r: Column, i: Column) -> Column:
    """The issues of one route whose references hold: its edges in order, folded with aggregate()."""
    base = _at("routes/", i)
    one = lambda code, element, tail: F.array(_issue(code, element, F.concat(base, tail)))
    head, settings = F.try_element_at(x["heads"], r["start"]), _settings(r)
    allowed = F.create_map(*(F.lit(x) for kv in _ALLOWED.items() for x in kv))
    first, forward = F.try_element_at(x["tracks"], F.get(r["path"], F.lit(0))), head["direction"] == "a_to_b"
    far = F.when(forward, first["b"]).otherwise(first["a"])
    begun = F.struct(far["node"].alias("at"), far["port"].alias("port"), F.array().cast("array<string>").alias("walked"), _none().alias("found"), F.lit(True).alias("whole"), F.lit(0).alias("pos"))

    def step(acc: Column, edge_id: Column) -> Column:
        track = F.try_element_at(x["tracks"], edge_id)
        seen = F.struct(track["a"].alias("a"), track["b"].alias("b"), F.try_element_at(x["kinds"], acc["at"]).alias("kind"), F.try_element_at(settings, acc["at"]).alias("declared"))

        def met(s: Column) -> Column:
            from_a = s["a"]["node"] == acc["at"]
            out = F.when(from_a, s["a"]["port"]).when(s["b"]["node"] == acc["at"], s["b"]["port"])
            setting = let(out, lambda o: F.try_element_at(allowed, F.concat_ws("|", s["kind"], path_key(F.array(acc["port"], o)))))
            fields = {"kind": s["kind"], "declared": s["declared"], "out": out, "on": F.when(from_a, s["b"]).otherwise(s["a"]), "setting": setting}
            return F.struct(*(v.alias(k) for k, v in fields.items()))

        def judged_step(s: Column) -> Column:
            pos, kind, setting = acc["pos"] + 1, s["kind"], s["setting"]
            position, switching = position_of(s["declared"]), s["kind"].isin(rules.SWITCHING)
            fits = F.when(position.isNotNull(), (kind == "switch") & (position == setting)).otherwise(kind.isin(rules.SLIPS) & F.coalesce(path_of(s["declared"]) == setting, F.lit(False)))
            code = (
                F.when(s["out"].isNull(), "ROUTE_DISCONTIGUOUS").when(setting.isNull(), "ROUTE_INVALID_TRAVERSAL")
                .when(switching & s["declared"].isNull(), "ROUTE_SWITCH_MISSING").when(switching & ~fits, "ROUTE_SWITCH_MISMATCH")
            )
            severity = lambda c: F.when(c == "ROUTE_SWITCH_MISSING", "warning").otherwise("error")
            element = lambda c: F.when(c == "ROUTE_DISCONTIGUOUS", r["id"]).otherwise(acc["at"])
            tail = lambda c: F.when(c.startswith("ROUTE_SWITCH"), _at("/switch_positions/", acc["at"])).otherwise(_at("/path/", pos))
            issue = lambda c: F.struct(c.alias("code"), severity(c).alias("severity"), element(c).alias("element_id"), F.concat(base, tail(c)).alias("path"))
            stop = ~acc["whole"] | kind.isNull()
            goes = ~stop & s["out"].isNotNull()
            found = F.when(stop, acc["found"]).otherwise(F.concat(acc["found"], F.transform(F.array_compact(F.array(code)), issue)))
            walked = F.when(goes & setting.isNotNull() & switching, F.array_append(acc["walked"], acc["at"])).otherwise(acc["walked"])
            at, port = (F.when(goes, s["on"][k]).otherwise(acc[old]) for k, old in (("node", "at"), ("port", "port")))
            return F.struct(at.alias("at"), port.alias("port"), walked.alias("walked"), found.alias("found"), goes.alias("whole"), pos.alias("pos"))

        return let(let(seen, met), judged_step)

    def ended(walk: Column) -> Column:
        goal = F.try_element_at(x["heads"], r["end"])
        end_ok = F.when(goal.isNotNull(), goal["edge"] == F.element_at(r["path"], -1)).when(F.array_contains(x["nodes_ids"], r["end"]), r["end"] == walk["at"]).otherwise(True)
        extra = F.array_except(F.array_intersect(F.map_keys(settings), x["nodes_ids"]), walk["walked"])
        extras = F.transform(extra, lambda k: _issue("ROUTE_SWITCH_MISMATCH", k, _at(base, "/switch_positions/", k)))
        after = F.concat(F.when(end_ok, _none()).otherwise(one("ROUTE_DISCONTIGUOUS", r["id"], F.lit("/end"))), extras)
        return F.when(walk["whole"], F.concat(walk["found"], after)).otherwise(walk["found"])

    rest = F.slice(r["path"], F.lit(2), F.greatest(F.size(r["path"]) - 1, F.lit(0)))
    walked = F.flatten(F.transform(F.array(F.aggregate(rest, begun, step)), ended))
    fits = F.get(r["path"], F.lit(0)) == head["edge"]
    known = head.isNotNull() & F.array_contains(x["edges_ids"], head["edge"]) & (F.size(F.array_except(r["path"], x["edges_ids"])) == 0)
    return F.when(~F.coalesce(known, F.lit(False)), _none()).when(~fits, one("ROUTE_DISCONTIGUOUS", r["id"], F.lit("/path/0"))).otherwise(walked)


def rule13_route_walk(x: Column) -> Column:
    """Walks every route whose references hold.

    A route starts on its start signal's edge, leaves it at the far end, and goes on over edges that touch where it
    stands, through paths that the node allows; switching nodes have to be declared as the path needs them."""
    return F.flatten(F.transform(x["routes"], lambda r, i: _walk(x, r, i)))


_LISTED_IDS = " ".join(f"{n}_ids" for n in _SHORT.values())
_STATE_KEYS = " ".join(f"state_{f}" for f in _STATED)
#: Rule -> its expression, and the look-ups that it needs.
RULES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "rule1_dup_ids": (rule1_duplicate_ids, f"nodes edges signals derailers routes {_LISTED_IDS}"),
    "rule2_edge_refs": (rule2_edge_references, "ends nodes_ids"),
    "rule2_attachments": (rule2_attachments, "signals derailers edges_ids"),
    "rule3_ports": (rule3_ports, "ends kinds"),
    "rule4_port_dup": (rule4_port_twice, "ends"),
    "rule5_self_loop": (rule5_self_loops, "edges"),
    "rule6_degree": (rule6_degree, "nodes degrees"),
    "rule7_half_labels": (rule7_half_labels, "nodes"),
    "rule8_geometry": (rule8_geometry, "scene nodes edges signals derailers"),
    "rule9_state_keys": (rule9_state_keys, f"{_STATE_KEYS} {_LISTED_IDS}"),
    "rule10_state_fields": (rule10_state_fields, "scene kinds"),
    "rule11_path_sets": (rule11_path_sets, "scene kinds"),
    "rule12_route_refs": (rule12_route_references, f"routes {_LISTED_IDS}"),
    "rule13_route_walk": (rule13_route_walk, "routes heads tracks kinds nodes_ids edges_ids"),
    "rule14_state_missing": (rule14_missing_states, f"nodes {_STATE_KEYS} {_LISTED_IDS}"),
}


def exploded(rows: DataFrame, issues: str = "issues") -> DataFrame:
    """A row for each issue: doc, code, severity, element_id, path."""
    return rows.select("doc", F.inline(issues)).select(*ISSUE)


def apply(scenes: DataFrame, *names: str) -> DataFrame:
    """The issues of some rules, a row each."""
    return exploded(scenes.select("doc", judged(F.col("scene"), *names).alias("issues")))


def promoted(issues: Column, strict: bool) -> Column:
    """Strict validation: some warnings count as errors."""
    if not strict:
        return issues
    severity = lambda x: F.when(x["code"].isin(rules.PROMOTED), "error").otherwise(x["severity"])
    return F.transform(issues, lambda x: x.withField("severity", severity(x)))


def ordered(issues: Column) -> Column:
    """By path, code and element; nulls as empty texts."""
    text = lambda x: F.coalesce(x, F.lit(""))
    keyed = F.transform(issues, lambda x: F.struct(text(x["path"]).alias("p"), x["code"].alias("c"), text(x["element_id"]).alias("e"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def validate(scenes: DataFrame, strict: bool = False, *keep: str) -> DataFrame:
    """(doc, the columns keep, issues) of every scene (doc, scene): an array in order, empty if all is right.

    One projection; repeated rows come out as often as they went in."""
    return scenes.select("doc", *keep, ordered(promoted(judged(F.col("scene"), *RULES), strict)).alias("issues"))


def validate_documents(docs: DataFrame, strict: bool = False, body: str = "body", *keep: str) -> DataFrame:
    """(doc, the columns keep, issues) of JSON texts (doc, body): where the shape is wrong, SCHEMA_INVALID and nothing
    else; elsewhere the rules, in order. Text that is no JSON object, a null too, has one issue at the path "".

    One projection without shuffle or table, so documents that arrive as a stream are validated by the same call;
    repeated rows come out as often as they went in. The expression is large: to build it takes some seconds a query."""
    docs = docs.withColumn("_wrong", shape_problems(F.col(body)))
    shape = lambda p: F.struct(F.lit("SCHEMA_INVALID").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("element_id"), p.alias("path"))
    found = let(F.from_json(F.col(body), SCENE), lambda scene: ordered(promoted(judged(scene, *RULES), strict)))
    issues = F.when(F.size("_wrong") > 0, F.transform("_wrong", shape)).otherwise(found)
    return docs.select("doc", *keep, issues.alias("issues"))


def report(rows: DataFrame) -> DataFrame:
    """Of (doc, issues): ok, n_errors, n_warnings, and all issues in order as code@path, joined by ' '."""
    count = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s)).cast("long")
    text = F.array_join(F.transform("issues", lambda x: F.concat(x["code"], F.lit("@"), x["path"])), " ")
    return rows.select("doc", (count("error") == 0).alias("ok"), count("error").alias("n_errors"), count("warning").alias("n_warnings"), text.alias("issues"))
