"""Prompt templates with named slots. Models are tuned to their prompts, so a deployment registers its own texts under these names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "prose": "Rewrite the markdown below as plain prose. Keep every fact.\n{text}",
    "boundary": 'Does a new topic begin with the next page? Answer {"boundary": true} or {"boundary": false}.\nSo far: {tail}\nNext: {page}',
    "lumber": 'The passages below are numbered from 0. Answer {"boundary_id": n}, n being the last that belongs to the first topic.\n{passages}',
    "useful": 'Is this text worth keeping? Answer {"is_useful": true} or {"is_useful": false}.\n{text}',
    "summary": "Summarize in a few sentences.\n{text}",
    "split": 'Split into self-contained parts. Answer [{"chunk": "..."}].\nSummary: {summary}\nText: {text}',
    "declare": "Turn the question and its answer into one statement.\nQuestion: {question}\nAnswer: {answer}",
    "qa_single": 'Write questions that this text answers. Answer [{"question": "...", "answer": "..."}].\nSource: {source}\nSummary: {summary}\nText: {text}',
    "qa_cited": 'Write questions whose answers quote the notes. Answer [{"question": "...", "answer": [{"sentence": "...", "reference": [{"source": "...", "text": "..."}]}]}].\n{notes}',
    "qa_multi": 'Write questions that need both texts. Answer [{"question": "...", "answer": "...", "supporting_fact_a": "...", "supporting_fact_b": "..."}].\nA: {text_a}\nB: {text_b}',
    "qa_choice": 'Write a question with five options "1) ..." to "5) ..." and the digit of the right one.\n{text}',
    "answer": "Answer the question.\n{question}",
    "answer@ko": "질문에 답하라.\n{question}",
    "answer_context@ko": "주어진 자료만 보고 답하라.\n자료: {context}\n질문: {question}",
    "answer_choice@ko": "보기에서 하나를 골라 번호로 답하라.\n{question}\n{options}",
    "answer_context_choice@ko": "주어진 자료만 보고 보기에서 하나를 골라 번호로 답하라.\n자료: {context}\n질문: {question}\n{options}",
    "answer_choice": "Choose one option and answer with its digit.\n{question}\n{options}",
    "answer_context": "Answer from the context only.\nContext: {context}\nQuestion: {question}",
    "answer_context_choice": "Choose one option from the context only.\nContext: {context}\nQuestion: {question}\n{options}",
    "consult": "Advise the asker, from the context.\nContext: {context}\nQuestion: {question}",
    "consult_extended": "Advise the asker, from the context and the readings.\nContext: {context}\nReadings: {readings}\nQuestion: {question}",
    "critic": 'Is the answer complete? Answer [{"iter_needed": true, "new_query": "..."}].\nQuestion: {question}\nAnswer: {answer}',
    "interpret": 'Read the question. Answer {"crop": "...", "modelType": [], "task": [], "keyword": []}.\n{question}',
    "relevance": 'How relevant is the text to the question? Answer {"score": 0..1}.\nQuestion: {question}\nText: {text}',
    "faithfulness": 'Does the text support the answer? Answer {"score": 0..1}.\nText: {text}\nAnswer: {answer}',
}


def render(name: str, language: str = "", **slots: Column) -> Column:
    """The template with its slots filled; null slots are empty. Slots inside values stay as they are: the template is cut at its own slots first.

    With a language the template "name@language" is taken where there is one.
    """
    parts, rest = [], TEMPLATES.get(f"{name}@{language}", TEMPLATES[name])
    while rest:
        found = sorted((rest.find("{" + s + "}"), s) for s in slots if "{" + s + "}" in rest)
        if not found:
            break
        at, slot = found[0]
        parts += [F.lit(rest[:at]), F.coalesce(slots[slot].cast("string"), F.lit(""))]
        rest = rest[at + len(slot) + 2 :]
    return F.concat(*parts, F.lit(rest))


def answering(question: Column, context: Column, options: Column, language: str = "") -> Column:
    """The prompt that a question is answered with: from its context or without, with options to choose from or none. Blank contexts and options count as none."""
    given = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    chosen = F.when(given(context) & given(options), render("answer_context_choice", language, context=context, question=question, options=options))
    chosen = chosen.when(given(options), render("answer_choice", language, question=question, options=options))
    return chosen.when(given(context), render("answer_context", language, context=context, question=question)).otherwise(render("answer", language, question=question))
