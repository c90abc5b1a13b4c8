"""Prompt tables and chat payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Goals by environment.
GOALS = {
    "metaworld_sweep-into-v2": "to minimize the distance between the green cube and the hole",
    "metaworld_drawer-open-v2": "to open the drawer",
    "metaworld_door-open-v2": "to open the safe door",
    "metaworld_soccer-v2": "to move the soccer ball into the goal",
    "CartPole-v1": "to balance the brown pole on the black cart to be upright",
    "softgym_RopeFlattenEasy": "to straighten the blue rope",
    "softgym_PassWater": "to move the container, which holds water, to be as close to the red circle as possible without causing too many water droplets to spill",
    "softgym_ClothFoldDiagonal": "to fold the cloth diagonally from top left corner to bottom right corner",
}
# Statements of a goal that is achieved, for models that compare an image with a text.
STATEMENTS = {
    "metaworld_sweep-into-v2": "The green cube is in the hole.",
    "metaworld_drawer-open-v2": "The drawer is opened.",
    "metaworld_door-open-v2": "The safe door is opened.",
    "metaworld_soccer-v2": "The soccer ball is in the goal.",
    "CartPole-v1": "pole vertically upright on top of the cart.",
    "softgym_RopeFlattenEasy": "The blue rope is straightened.",
    "softgym_PassWater": "The container, which holds water, is as close to the red circle as possible without causing too many water droplets to spill.",
    "softgym_ClothFoldDiagonal": "The cloth is folded diagonally from top left corner to bottom right corner.",
}
# Templates in our own words; {goal} is the goal, {reply} the first reply.
TEMPLATES = {
    "query": "Describe Image 1. Describe Image 2. The goal is {goal}. How do the images differ in achieving it?",
    "summary": "Given this analysis:\n{reply}\nThe goal is {goal}. Answer with one line: 0 if Image 1 achieves it better, 1 if Image 2 does, -1 if neither or unclear.",
    "single": "The goal is {goal}. Answer with one line: 0 if Image 1 achieves it better, 1 if Image 2 does, -1 if neither or unclear.",
    "score": "Describe the image. The goal is {goal}. How well is it achieved, from 0 to 1?",
    "score_summary": "Given this analysis:\n{reply}\nThe goal is {goal}. Answer with one line: the score, or -1 if unsure.",
}
BREVITY = " Be brief."


def prompt_table(spark: SparkSession, goals: dict[str, str] | None = None) -> DataFrame:
    """prompts(env, kind, template), the goal filled in, the reply slot left; kind statement is the goal as achieved."""
    rows = [(env, kind, t.replace("{goal}", goal)) for env, goal in (goals or GOALS).items() for kind, t in TEMPLATES.items()]
    rows += [(env, "statement", text) for env, text in STATEMENTS.items()]
    return spark.createDataFrame(rows, "env string, kind string, template string")


def render(template: Column, reply: Column | None = None, brief: bool = False) -> Column:
    text = template if reply is None else F.replace(template, F.lit("{reply}"), F.coalesce(reply, F.lit("")))
    return F.concat(text, F.lit(BREVITY)) if brief else text


def chat_payload(text: Column, images: list[Column], max_tokens: int = 512, temperature: float = 0.0) -> Column:
    """The JSON of a chat request: images (PNG bytes) as base64 data URIs, then the text."""
    part = lambda kind, body, image: F.struct(F.lit(kind).alias("type"), body.alias("text"), image.alias("image"))
    none = F.lit(None).cast("string")
    shown = [part("image", none, F.concat(F.lit("data:image/png;base64,"), F.base64(i))) for i in images]
    content = F.array(*shown, part("text", text, none))
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.array(message).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(float(temperature)).alias("temperature")))
