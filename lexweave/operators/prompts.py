"""Prompts and answer shapes of the HTTP adapter, built from the schemas."""

from __future__ import annotations

from typing import Any

from lexweave import schemas

EXTRACTION = (
    "List who takes part in the court case that this passage belongs to: people, organizations and courts. "
    "Give a role only if the passage states it right next to the name. Works, exhibits, testimony and other cases that are "
    "merely cited are of type reference; use that type when in doubt. Quote the words that support each entry."
)
JUDGMENT = (
    "Decide for each numbered candidate whether the new mention names the same real person, organization or court. "
    "Answer same only with evidence such as a shared case number, role or context; different if the facts speak against it, "
    "even if names are equal; unsure only if facts are missing. Merging two different people is the worse mistake. "
    "Give one judgment per candidate, in their order, each with a reason of a few words."
)


def _object(**properties: Any) -> dict[str, Any]:
    return {"type": "object", "required": list(properties), "properties": properties}


def extraction_shape() -> dict[str, Any]:
    text, pick = {"type": "string"}, lambda values: {"type": "string", "enum": list(values)}
    entity = _object(name=text, type=pick(schemas.ENTITY_TYPES), candidate_role=pick(schemas.ROLES), textual_evidence=text, confidence=pick(schemas.CONFIDENCES))
    return _object(entities={"type": "array", "items": entity})


def judgment_shape(candidates: int) -> dict[str, Any]:
    one = _object(verdict={"type": "string", "enum": list(schemas.VERDICTS)}, reason={"type": "string"})
    return _object(judgments={"type": "array", "items": one, "minItems": candidates, "maxItems": candidates})
