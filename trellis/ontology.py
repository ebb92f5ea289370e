"""The vocabulary as Turtle, and the shapes that a registry should meet."""

from __future__ import annotations

from trellis.functions.terms import PROV, RDF, RDFS, SH, XSD

# The names of the vocabulary.
CLASSES = {
    "": [
        "Holon", "Portal", "LayerGraph", "HolonicGraph", "LayerRole", "PortalType", "MembraneHealth", "DataDomain", "BusinessProcess", "ExternalSystem",
        "Capability", "ClassificationLevel", "HolonStatus", "HolonSplit", "HolonMerge", "ClassInstanceCount", "ProjectionPipelineSpec",
        "ProjectionPipelineStep",
    ],
    "Holon": [
        "DataHolon", "AlignmentHolon", "AgentHolon", "GovernanceHolon", "AggregateHolon", "IndexHolon", "EphemeralHolon", "PersistentHolon",
    ],
    "Portal": [
        "TransformPortal", "IconPortal", "SealedPortal",
    ],
}
INDIVIDUALS = {
    "LayerRole": [
        "InteriorRole", "BoundaryRole", "ProjectionRole", "ContextRole", "RegistryRole",
    ],
    "PortalType": [
        "Unidirectional", "Bidirectional",
    ],
    "MembraneHealth": [
        "Intact", "Weakened", "Compromised",
    ],
    "HolonStatus": [
        "Active", "Archived", "Proposed",
    ],
}
OBJECT_PROPERTIES = [
    "hasInterior", "hasBoundary", "hasProjection", "hasContext", "hasPortal", "sourceHolon", "targetHolon", "sourceLayer", "memberOf", "adjacentTo",
    "derivedFrom", "dataSteward", "steward", "authority", "supportsProcess", "usesSystem", "hasCapability", "holonStatus", "membraneHealth",
    "dataClassification", "supersededBy", "requiresInput", "producesOutput", "inGraph", "class", "graphRole", "hasPipeline", "hasStep",
]
DATA_PROPERTIES = [
    "depth", "constructQuery", "isTraversable", "activationEvent", "gateCondition", "lastIngestion", "refreshFrequency", "interiorTripleCount",
    "materializationMode", "systemType", "splitRationale", "mergeRationale", "lastProjectionHash", "tripleCount", "lastModified", "refreshedAt", "count",
    "holonLastModified", "stepName", "transformName", "transformVersion", "runHost", "runPlatform", "runPythonVersion",
]


def _head(vocabulary: str) -> str:
    return f"@prefix cga: <{vocabulary}> . @prefix rdf: <{RDF}> . @prefix rdfs: <{RDFS}> . @prefix sh: <{SH}> . @prefix xsd: <{XSD}> . @prefix prov: <{PROV}> .\n"


def ontology(vocabulary: str) -> str:
    out = [_head(vocabulary)]
    for parent, names in CLASSES.items():
        out += [f'cga:{n} a rdfs:Class ; rdfs:label "{n}"' + (f" ; rdfs:subClassOf cga:{parent}" if parent else "") + " ." for n in names]
    out.append("cga:LayerGraph rdfs:subClassOf cga:HolonicGraph .")
    out += [f"cga:{n} a cga:{kind} ." for kind, names in INDIVIDUALS.items() for n in names]
    out += [f'cga:{n} a rdf:Property ; rdfs:label "{n}" .' for n in [*OBJECT_PROPERTIES, *DATA_PROPERTIES]]
    return "\n".join(out)


# What the shapes ask of a registry. For each shape its target class, and for each path the constraint and the severity.
PROPERTY_SHAPES = {
    "HolonShape": ("Holon", [
        ("rdfs:label", "sh:maxCount 1 ; sh:datatype xsd:string", "Info", "One label at most, a string."),
        ("cga:hasInterior", "", "Info", "Interior graphs."),
        ("cga:memberOf", "sh:maxCount 1 ; sh:nodeKind sh:IRI", "Info", "One parent at most."),
        ("cga:holonStatus", "sh:maxCount 1", "Info", "One status at most."),
    ]),
    "PortalShape": ("Portal", [
        ("cga:sourceHolon", "sh:minCount 1 ; sh:maxCount 1 ; sh:nodeKind sh:IRI", "Violation", "A portal has one source."),
        ("cga:targetHolon", "sh:minCount 1 ; sh:maxCount 1 ; sh:nodeKind sh:IRI", "Violation", "A portal has one target."),
        ("rdfs:label", "sh:minCount 1", "Warning", "A portal has a label."),
    ]),
    "TransformPortalShape": ("TransformPortal", [("cga:constructQuery", "sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string", "Violation", "A transform portal carries one query.")]),
    "IconPortalShape": ("IconPortal", [("cga:constructQuery", "sh:maxCount 0", "Warning", "An icon portal only refers: it carries no query.")]),
    "SealedPortalShape": ("SealedPortal", [("cga:constructQuery", "sh:maxCount 0", "Warning", "A sealed portal is never crossed: it carries no query.")]),
    "DataDomainShape": ("DataDomain", [("rdfs:label", "sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string", "Violation", "A domain has one label.")]),
    "DataHolonGovernanceShape": ("DataHolon", [
        ("cga:dataSteward", "sh:maxCount 1 ; sh:nodeKind sh:IRI", "Warning", "One steward at most."),
        ("cga:dataClassification", "sh:maxCount 1 ; sh:nodeKind sh:IRI ; sh:class cga:ClassificationLevel", "Warning", "One classification at most, a level."),
    ]),
    "ExternalSystemShape": ("ExternalSystem", [
        ("rdfs:label", "sh:minCount 1", "Violation", "A system has a label."),
        ("cga:systemType", "sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string", "Warning", "A system has one type."),
    ]),
    "CapabilityShape": ("Capability", [
        ("rdfs:label", "sh:minCount 1", "Violation", "A capability has a label."),
        ("cga:requiresInput", "sh:maxCount 1", "Info", "One input shape at most."),
        ("cga:producesOutput", "sh:maxCount 1", "Info", "One output shape at most."),
    ]),
    "BusinessProcessShape": ("BusinessProcess", [("rdfs:label", "sh:minCount 1", "Violation", "A process has a label.")]),
    "HolonStewardshipShape": ("Holon", [
        ("cga:dataSteward", "sh:maxCount 1 ; sh:nodeKind sh:IRI", "Info", "One steward at most."),
        ("cga:dataClassification", "sh:maxCount 1 ; sh:nodeKind sh:IRI ; sh:class cga:ClassificationLevel", "Info", "One classification at most, a level."),
    ]),
    "AlignmentHolonShape": ("AlignmentHolon", [
        ("rdfs:label", "sh:minCount 1", "Warning", "An alignment has a label."),
        ("cga:hasInterior", "sh:minCount 1", "Warning", "An alignment keeps its mapping in an interior."),
    ]),
    "AgentHolonShape": ("AgentHolon", [
        ("rdfs:label", "sh:minCount 1", "Warning", "An agent has a label."),
        ("cga:hasInterior", "sh:minCount 1", "Info", "An agent keeps its state in an interior."),
        ("cga:hasBoundary", "sh:minCount 1", "Info", "An agent's output has a boundary."),
        ("cga:hasContext", "sh:minCount 1", "Info", "An agent's history has a context."),
    ]),
    "AggregateHolonShape": ("AggregateHolon", [("rdfs:label", "sh:minCount 1", "Warning", "An aggregate has a label.")]),
    "HolonOperationalShape": ("Holon", [
        ("cga:lastIngestion", "sh:maxCount 1 ; sh:datatype xsd:dateTime", "Info", "One time of ingestion at most."),
        ("cga:refreshFrequency", "sh:maxCount 1 ; sh:datatype xsd:duration", "Info", "One refresh interval at most, a duration."),
        ("cga:interiorTripleCount", "sh:maxCount 1 ; sh:datatype xsd:integer", "Info", "One count at most, an integer."),
        ("cga:materializationMode", 'sh:maxCount 1 ; sh:datatype xsd:string ; sh:in ( "materialized" "virtualized" "cached" "hybrid" )', "Warning", "One of the four modes."),
    ]),
    "HolonSplitShape": ("HolonSplit", [
        ("prov:used", "sh:minCount 1 ; sh:maxCount 1 ; sh:nodeKind sh:IRI", "Violation", "A split has one origin."),
        ("prov:generated", "sh:minCount 2 ; sh:nodeKind sh:IRI", "Violation", "A split has two results or more."),
        ("cga:splitRationale", "sh:minCount 1 ; sh:datatype xsd:string", "Warning", "A split has a reason."),
        ("prov:startedAtTime", "sh:minCount 1 ; sh:datatype xsd:dateTime", "Warning", "A split has a time."),
    ]),
    "HolonMergeShape": ("HolonMerge", [
        ("prov:used", "sh:minCount 2 ; sh:nodeKind sh:IRI", "Violation", "A merge has two origins or more."),
        ("prov:generated", "sh:minCount 1 ; sh:maxCount 1 ; sh:nodeKind sh:IRI", "Violation", "A merge has one result."),
        ("cga:mergeRationale", "sh:minCount 1 ; sh:datatype xsd:string", "Warning", "A merge has a reason."),
    ]),
    "ArchivedHolonShape": ("?this cga:holonStatus cga:Archived", [("cga:supersededBy", "sh:minCount 1 ; sh:nodeKind sh:IRI", "Warning", "An archived unit names its successor.")]),
    "ProjectionPipelineSpecShape": ("ProjectionPipelineSpec", [
        ("rdfs:label", "sh:minCount 1", "Warning", "A pipeline has a label."),
        ("cga:hasStep", "sh:minCount 1", "Warning", "A pipeline has steps."),
    ]),
}
# The shapes that are graph patterns. For each its target class, the pattern of an offence and the severity.
PATTERN_SHAPES = {
    "PortalTargetExistsShape": ("Portal", "$this cga:targetHolon ?end . FILTER NOT EXISTS { ?end a cga:Holon }", "Violation", "The target is no unit."),
    "PortalSourceExistsShape": ("Portal", "$this cga:sourceHolon ?end . FILTER NOT EXISTS { ?end a cga:Holon }", "Violation", "The source is no unit."),
    "PortalNotArchivedShape": ("Portal", "$this cga:targetHolon ?end . ?end cga:holonStatus cga:Archived . FILTER NOT EXISTS { $this cga:holonStatus cga:Archived }", "Warning", "An active portal leads to an archived unit."),
    "PortalClassificationShape": ("Portal", "$this cga:sourceHolon ?from ; cga:targetHolon ?to . ?from cga:dataClassification ?a . ?to cga:dataClassification ?b . FILTER(?a != ?b)", "Warning", "The portal joins units of different classification."),
    "MemberOfTargetShape": ("Holon", "$this cga:memberOf ?end . FILTER NOT EXISTS { ?end a cga:Holon }", "Warning", "The parent is no unit."),
    "SelfMembershipShape": ("Holon", "$this cga:memberOf $this", "Violation", "A unit must not contain itself."),
    "ProjectionPipelineStepShape": ("ProjectionPipelineStep", "$this a cga:ProjectionPipelineStep . FILTER NOT EXISTS { $this cga:transformName ?t } FILTER NOT EXISTS { $this cga:constructQuery ?q }", "Warning", "A step has a transform or a query."),
}


def shapes(vocabulary: str, registry: str) -> str:
    """The shapes for the registry graph as Turtle; patterns are asked of that graph alone."""
    select = lambda pattern: f"PREFIX cga: <{vocabulary}> SELECT $this WHERE {{ GRAPH <{registry}> {{ {pattern} }} }}"
    out = [_head(vocabulary)]
    for name, (target, properties) in PROPERTY_SHAPES.items():
        to = f'sh:target [ a sh:SPARQLTarget ; sh:select "{select(target)}" ]' if target.startswith("?") else f"sh:targetClass cga:{target}"
        asked = [f'sh:property [ sh:path {path} ;{f" {limit} ;" if limit else ""} sh:severity sh:{severity} ; sh:message "{message}" ]' for path, limit, severity, message in properties]
        out.append(f"cga:{name} a sh:NodeShape ; " + " ;\n  ".join([to, *asked]) + " .")
    for name, (target, pattern, severity, message) in PATTERN_SHAPES.items():
        out.append(f'cga:{name} a sh:NodeShape ; sh:targetClass cga:{target} ;\n  sh:sparql [ sh:select "{select(pattern)}" ; sh:severity sh:{severity} ; sh:message "{message}" ] .')
    return "\n".join(out) + "\n"
