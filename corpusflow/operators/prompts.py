"""Prompts as columns: messages with a role and a content, built from templates with slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own templates.
SYSTEM = "You answer questions from the passages below. Answer in the language of the question. If the passages don't hold the answer, say so."
QUESTION = "Passages:\n{context}\n\nQuestion: {query}"
GREETING = "Greet the user briefly and offer help. The user wrote: {query}"
SIMPLE = "Answer this simple question in one or two sentences: {query}"
CALCULATOR = "Work out the result and show the steps: {query}"
NO_ANSWER = {
    "long": "Nothing in the available documents answers this question. Please put it differently, or add a document that covers the subject.",
    "short": "No matching document was found.",
}


def fill(template: str, **slots: Column) -> Column:
    """The template with its slots filled; what fills a slot isn't searched for slots."""
    out: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + k + "}"), k) for k in slots if "{" + k + "}" in rest]
        if not found:
            out.append(F.lit(rest))
            break
        at, name = min(found)
        out += [F.lit(rest[:at]), F.coalesce(slots[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def answer_prompt(context: Column, query: Column, past: Column | None = None) -> Column:
    """System, the history if there is any, and the question with its passages."""
    head, tail = F.array(message("system", F.lit(SYSTEM))), F.array(message("human", fill(QUESTION, context=context, query=query)))
    if past is None:
        return F.concat(head, tail)
    return F.concat(head, F.coalesce(past, F.array().cast("array<struct<role:string,content:string>>")), tail)


def route_prompt(route: Column, query: Column, context: Column) -> Column:
    """The prompt that suits the route."""
    return (
        F.when(route == "greeting", F.array(message("human", fill(GREETING, query=query))))
        .when(route == "simple", F.array(message("human", fill(SIMPLE, query=query))))
        .when(route == "calculator", F.array(message("human", fill(CALCULATOR, query=query))))
        .otherwise(answer_prompt(context, query))
    )


def no_answer(provider: Column) -> Column:
    """What is said when nothing was found: at length for the hosted default, in short for others."""
    return F.when(provider == "hosted", F.lit(NO_ANSWER["long"])).otherwise(F.lit(NO_ANSWER["short"]))
