"""Declared schemas of the map tables; nothing is inferred. Names follow the JSON files' fields."""

from __future__ import annotations

_ITEM = "uid string, type int, x double, y double, dlcGuard int, hidden boolean, secret boolean"

#: Table name -> DDL. Uids are hex texts; optional booleans are true or null.
SCHEMAS = {
    "nodes": "uid string, x double, y double, z double, rotation double, rotationQuat array<double>, forwardItemUid string, backwardItemUid string, forwardCountryId int, backwardCountryId int",
    "elevation": "p array<double>",
    "roads": f"{_ITEM}, roadLookToken string, startNodeUid string, endNodeUid string, length double, maybeDivided boolean",
    "prefabs": f"{_ITEM}, token string, nodeUids array<string>, originNodeIndex int, ferryLinkUid string",
    "companies": "uid string, type int, x double, y double, token string, cityToken string, prefabUid string, nodeUid string",
    "ferries": "uid string, token string, train boolean, name string, nameLocalized string, nodeUid string, prefabUid string, x double, y double, dlcGuard int, connections array<struct<token string, name string, nodeUid string, x double, y double, price double, time double, distance double, intermediatePoints array<struct<x double, y double, rotation double>>>>",
    "cities": "token string, name string, nameLocalized string, countryToken string, population bigint, x double, y double, dlcGuard int, areas array<struct<uid string, type int, x double, y double, token string, hidden boolean, width double, height double>>",
    "countries": "token string, name string, nameLocalized string, id int, x double, y double, code string, timeZone int, secondaryTimeZones array<struct<extent array<double>, timeZone int>>, truckSpeedLimits map<string, struct<limit double, urbanLimit double, maxLimit double>>",
    "companyDefs": "token string, name string, cityTokens array<string>, cargoInTokens array<string>, cargoOutTokens array<string>, dlcGuard int",
    "mapAreas": "uid string, type int, x double, y double, dlcGuard int, secret boolean, drawOver boolean, nodeUids array<string>, color int",
    "dividers": "uid string, type int, x double, y double, scheme string, subcurves array<struct<model string, look string, numBuildings int>>, startNodeUid string, endNodeUid string",
    "trajectories": "uid string, type int, x double, y double, nodeUids array<string>, checkpoints array<struct<route string, checkpoint string>>",
    "cutscenes": "uid string, type int, x double, y double, dlcGuard int, secret boolean, flags bigint, tags array<string>, nodeUid string, actionStringParams array<string>",
    "signs": "uid string, type int, x double, y double, token string, nodeUid string, textItems array<string>",
    "triggers": "uid string, type int, x double, y double, dlcGuard int, secret boolean, nodeUids array<string>",
    "models": "uid string, type int, x double, y double, token string, nodeUid string, scale struct<x double, y double, z double>",
    "pois": "type string, icon string, x double, y double, secret boolean, label string, cityToken string, dlcGuard int, nodeUid string, prefabUid string, itemNodeUids array<string>",
    "roadLooks": "token string, lanesLeft array<string>, lanesRight array<string>, offset double, laneOffset double, shoulderSpaceLeft double, shoulderSpaceRight double",
    "prefabDescriptions": "token string, path string, nodes array<struct<x double, y double, z double, rotation double, inputLanes array<int>, outputLanes array<int>>>, navCurves array<struct<navNodeIndex int, nextLines array<int>, prevLines array<int>, semaphoreId int, trafficRule string>>",
    "modelDescriptions": "token string, center struct<x double, y double>, start struct<x double, y double>, end struct<x double, y double>, height double",
    "signDescriptions": "token string, name string, modelDesc string, category string, editable boolean",
    "cargoes": "token string, name string, fragility double, volume double, mass double, bodyTypes array<string>, `group` array<string>, dlcGuard int",
    "achievements": "token string, type string",
    "routes": "token string, fromCity string, toCity string, cargoTokens array<string>",
    "mileageTargets": "token string, editorName string, defaultName string, nameVariants array<string>, distanceOffset double, nodeUid string, x double, y double, searchRadius double",
}

#: Keys of the keyed tables; `pois` and `elevation` have none.
KEYS = {t: "uid" if ddl.startswith("uid ") else "token" for t, ddl in SCHEMAS.items() if t not in ("pois", "elevation")} | {"ferries": "token"}

#: What is added to a focus radius when a table is read; None means the table isn't filtered by place.
PADDING: dict[str, float | None] = {"nodes": 1000.0, "mapAreas": 200.0} | dict.fromkeys(("roads", "ferries", "prefabs", "companies", "models", "pois", "dividers", "signs", "cities"), 0.0)

GEOJSON = "type string, features array<struct<type string, id string, geometry struct<type string, coordinates string>, properties map<string, string>>>"

TELEMETRY = "device bigint, game struct<timestamp bigint, time int, paused boolean>, truck struct<speed double, position struct<X double, Y double, Z double>, heading double>, navigation struct<speedLimit double>"
