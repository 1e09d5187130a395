"""Wording of tokens, questions and prompts as column functions over a dictionary of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T

# Log ratios of the words for weights; irregular forms of verbs; how questions open and what replaces the
# opening in a statement, the first fitting one counts; labels and verb phrases of questions with values; values that
# say that nobody travelled, and what is then said.
ORDINAL_BANDS = {
    "strongly_argues_for": 2.302585,
    "moderately_argues_for": 1.609438,
    "weakly_argues_for": 0.693147,
    "uninformative": 0.0,
    "weakly_argues_against": -0.693147,
    "moderately_argues_against": -1.609438,
    "strongly_argues_against": -2.302585,
}
THIRD_PERSON = {"have": "has", "be": "is", "do": "does", "go": "goes", "lose": "loses", "eat": "eats", "vomit": "vomits", "suffer": "suffers"}
PAST = {"lose": "lost", "vomit": "vomited", "eat": "ate", "have": "had", "suffer": "suffered", "turn": "turned", "be": "was"}
OPENINGS = [
    ("do you have", "has"),
    ("do you feel", "feels"),
    ("do you live", "lives"),
    ("do you take", "takes"),
    ("do you suffer", "suffers"),
    ("do you work", "works"),
    ("do you regularly", "regularly {verb}"),
    ("do you currently", "currently {verb}"),
    ("do your", "their"),
    ("do any members of", "among"),
    ("does your", "their"),
    ("does the", "the"),
    ("have you ever", "has ever"),
    ("have you had", "has had"),
    ("have you been", "has been"),
    ("have you noticed", "has noticed"),
    ("have you recently", "has recently"),
    ("have you lost", "has lost"),
    ("have you traveled", "has travelled"),
    ("have any of", "any of"),
    ("has any", "any"),
    ("are you currently", "is currently"),
    ("are you more", "is more"),
    ("are your symptoms", "symptoms are"),
    ("are you consulting because you have", "is consulting because they have"),
    ("are you being", "is being"),
    ("are you feeling", "is feeling"),
    ("are you experiencing", "is experiencing"),
    ("are you taking", "is taking"),
    ("are you exposed", "is exposed"),
    ("are you unable", "is unable"),
    ("are you infected", "is infected"),
    ("are you significantly", "is significantly"),
    ("are you of", "is of"),
    ("are you a", "is a"),
    ("are you an", "is an"),
    ("have you or any member of your family ever had", "or a family member has had"),
    ("have you started or taken", "has started or taken"),
    ("are your vaccinations", "their vaccinations {rest} are up to date"),
    ("are your", "their"),
    ("are there any members of your family who have been diagnosed", "has a family member diagnosed with"),
    ("are there members of your family who have been diagnosed with", "has a family member diagnosed with"),
    ("do any members of your immediate family have", "has an immediate family member with"),
    ("are there any members of", "has a family member among"),
    ("are there members of", "has a family member among"),
    ("are the", "the"),
    ("is your", "their"),
    ("is the", "the"),
    ("were you diagnosed", "was diagnosed"),
    ("were you born", "was born"),
    ("in the last month, have you been", "in the last month has been"),
    ("did your", "their"),
]
#: Verbs after "do you" that OPENINGS treats.
OPENED = ["have", "feel", "live", "take", "suffer", "work", "regularly", "currently"]
ATTRIBUTES = {
    "Do you feel pain somewhere?": ("pain location", "has pain located at"),
    "Does the pain radiate to another location?": ("pain radiates to", "has pain radiating to"),
    "Characterize your pain:": ("pain character", "describes the pain as"),
    "How fast did the pain appear?": ("pain onset speed, 0 gradual to 10 sudden", "rates the speed of pain onset, on a scale where 0 is gradual and 10 is sudden, at"),
    "How intense is the pain?": ("pain intensity, 0-10", "rates the pain intensity, out of 10, at"),
    "How precisely is the pain located?": ("pain localisation precision, 0-10", "rates how precisely the pain is localised, out of 10, at"),
    "Where is the affected region located?": ("affected region", "has an affected region at"),
    "What color is the rash?": ("rash colour", "has a rash coloured"),
    "How intense is the pain caused by the rash?": ("rash pain intensity, 0-10", "rates the pain from the rash, out of 10, at"),
    "Is the rash swollen?": ("rash swelling, 0-10", "has rash swelling, out of 10, of"),
    "How severe is the itching?": ("itching severity, 0-10", "rates the itching, out of 10, at"),
    "Is the lesion (or are the lesions) larger than 1cm?": ("lesion larger than 1cm", "has lesions larger than 1cm:"),
    "Do your lesions peel off?": ("lesions peel off", "has lesions that peel off:"),
    "Where is the swelling located?": ("swelling location", "has swelling located at"),
    "Have you traveled out of the country in the last 4 weeks?": ("recent travel outside the country", "has recently travelled to"),
}
TRAVEL_CODE, NO_TRAVEL, NOT_TRAVELLED = "E_204", ["N", "n"], "has not travelled outside the country in the last 4 weeks"


def without_mark(question: Column) -> Column:
    return F.regexp_replace(question, r"\?+$", "")


def described(question: Column, binary: Column, value: Column, meanings: Column) -> Column:
    """A token for a prompt: its question and ``Yes``, or its value."""
    return F.concat(without_mark(question), F.lit("? "), F.when(binary, F.lit("Yes")).otherwise(T.shown(value, meanings)))


def inflected(verb: Column, odd: dict[str, str], plain: str, after_e: str, y_to: str) -> Column:
    """Lower-cased verb with an ending: plain, after_e after e (or after a hiss for the third person), y_to for consonant and y."""
    v = F.lower(verb)
    irregular = F.try_element_at(F.create_map(*[F.lit(x) for kv in odd.items() for x in kv]), v)
    e_like = "(s|sh|ch|x|z)$" if plain == "s" else "e$"
    ending = F.when(v.rlike(e_like), F.concat(v, F.lit(after_e))).when(v.rlike(".*[^aeiou]y$"), F.concat(F.regexp_replace(v, "y$", ""), F.lit(y_to)))
    return F.coalesce(irregular, ending, F.concat(v, F.lit(plain)))


def third_person(verb: Column) -> Column:
    return inflected(verb, THIRD_PERSON, "s", "es", "ies")


def past(verb: Column) -> Column:
    return inflected(verb, PAST, "ed", "d", "ied")


def declarative(question: Column) -> Column:
    """A yes-no question as a statement without its subject; null if no opening fits.

    The stripped question is worked out once, as the only entry of an array, and the rules look at that.
    """
    return F.get(F.transform(F.array(T.stripped(F.regexp_replace(T.stripped(question), r"\?+$", ""))), worded), F.lit(0))


def worded(q: Column) -> Column:
    """The first rule that fits a question without its mark."""
    part = lambda opening, group: F.regexp_extract(q, rf"(?is)^{opening} (\w+)\b(.*)$", group)
    joined = lambda *cs: T.stripped(F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs]))
    out = F.when(q.rlike(r"(?i)^did you \w+\b"), joined(past(part("did you", 1)), part("did you", 2)))
    generic = q.rlike(r"(?i)^do you \w+\b") & ~q.rlike(rf"(?i)^do you ({'|'.join(OPENED)})\b")
    out = out.when(generic, joined(third_person(part("do you", 1)), part("do you", 2)))
    for opening, new in OPENINGS:
        rest = T.stripped(F.regexp_replace(q, rf"(?i)^{opening}\b", ""))
        if new.endswith("{verb}"):
            head, tail = F.regexp_extract(rest, r"(?s)^(\w+)(.*)$", 1), F.regexp_extract(rest, r"(?s)^(\w+)(.*)$", 2)
            said = F.concat(F.lit(new.removesuffix("{verb}")), F.when(head != "", F.concat(third_person(head), tail)).otherwise(rest))
        elif "{rest}" in new:
            said = F.regexp_replace(F.concat(F.lit(new.split("{rest}")[0]), rest, F.lit(new.split("{rest}")[1])), " +", " ")
        else:
            said = F.concat(F.lit(f"{new} "), rest)
        out = out.when(q.rlike(rf"(?i)^{opening}\b"), said)
    for opening, new in (("are you", "is "), ("have you", "has ")):
        out = out.when(q.rlike(rf"(?i)^{opening} \w+\b"), joined(new, part(opening, 1), part(opening, 2)))
    return out


def finding_phrases(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tokens (with code and value) with bullet and prose, a finding's two forms.

    dictionary: code, question, binary and meanings (a map of values), a row per code, of a vocabulary's size. Tokens of
    an unknown code have null phrases.
    """
    rows = tokens.join(dictionary, "code", "left").withColumn("__q", T.stripped(F.col("question"))).withColumn("__value", T.shown(F.col("value"), F.col("meanings")))
    # a statement is a long expression that all phrases use: it is worked out once
    rows = rows.withColumn("__said", F.coalesce(declarative(F.col("__q")), F.concat(F.lit("reports "), without_mark(F.col("__q")))))
    value, labels = F.col("__value"), F.create_map(*[x for name, both in ATTRIBUTES.items() for x in (F.lit(name), F.array(*[F.lit(y) for y in both]))])
    rows = rows.withColumn("__labels", F.try_element_at(labels, F.col("__q")))
    plain = F.col("binary") & F.col("value").isNull()
    no_travel = (F.col("code") == TRAVEL_CODE) & value.isin(*NO_TRAVEL)
    stated = F.concat(F.col("__said"), F.lit(" ("), value, F.lit(")"))

    def phrase(labelled: Column) -> Column:
        said = T.depersonalised(F.when(plain, F.col("__said")).otherwise(F.coalesce(labelled, stated)))
        return F.when(~F.coalesce(plain, F.lit(False)) & no_travel, F.lit(NOT_TRAVELLED)).otherwise(said)

    bullet, prose = F.concat(F.get("__labels", F.lit(0)), F.lit(": "), value), F.concat(F.get("__labels", F.lit(1)), F.lit(" "), value)
    return rows.select(*tokens.columns, phrase(bullet).alias("bullet"), phrase(prose).alias("prose"))


def unmatched(dictionary: DataFrame) -> DataFrame:
    """code and question of the dictionary that no rule words: yes-no questions without an opening, others without a label."""
    known = F.col("question").isin(*ATTRIBUTES)
    return dictionary.filter(F.when(F.col("binary"), declarative(F.col("question")).isNull()).otherwise(~known)).select("code", "question")


def candidate_block(names: Column) -> Column:
    """Numbered lines, from 0."""
    return F.array_join(F.transform(names, lambda n, i: F.concat(i.cast("string"), F.lit(". "), n)), "\n")


def person(age: Column, sex: Column) -> Column:
    return F.concat(F.lit("A "), age.cast("string"), F.lit("-year-old "), F.when(sex == "M", "man").otherwise("woman"))


def prompt(names: Column, who: Column, findings: Column, ask: str, prior: Column | None = None, system: str = "You estimate chances from findings and always answer with numbers.") -> Column:
    """Messages (role, content) of a question: the numbered candidates, base rates with four digits if given, the person,
    the findings and what is asked, whose ``{n}`` becomes the number of candidates. The wording is the caller's."""
    rates = [] if prior is None else [F.concat(F.lit("Base rates in the order of the list: "), F.array_join(F.transform(prior, lambda p: F.format_string("%.4f", p)), ", "))]
    asked = F.replace(F.lit(ask), F.lit("{n}"), F.size(names).cast("string"))
    content = F.concat_ws("\n\n", F.lit("Candidates:"), candidate_block(names), *rates, F.concat(F.lit("Patient: "), who), findings, asked)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", content))


#: What is asked, in our own words, and the keys of the answers, which text.probabilities, text.weights and text.index read.
SCORES = 'Give each candidate a score from 0 (hardly possible) to 100 (nearly certain) for this person. Scores need no fixed sum, but must tell the candidates apart. Answer with a JSON object whose key "probabilities" holds {n} numbers in the order of the list.'
REASONED = "First weigh in writing which candidates the findings speak for and which against. Then do as follows. "
WEIGHTS = {
    "numeric": "For each candidate, how many times as likely is this finding with it as without it? 1 tells nothing, more speaks for it, less against it.",
    "logodds": "For each candidate, what is the natural logarithm of how many times as likely this finding is with it as without it? 0 tells nothing, positive speaks for it, negative against it.",
    "ordinal": "For each candidate, how strongly does this finding speak for or against it? Use one of these labels: {labels}.",
}
WEIGHT_ANSWER = ' Answer with a JSON object whose key "weights" holds {n} values in the order of the list.'
TOP_ANSWER = 'Which one candidate is the likeliest? Answer with a JSON object whose key "index" holds its number in the list.'


def posterior_prompt(names: Column, who: Column, findings: Column, prior: Column | None = None) -> Column:
    """Asks for a score of every candidate; with base rates if they are given."""
    return prompt(names, who, findings, SCORES, prior)


def reasoned_prompt(names: Column, who: Column, findings: Column, prior: Column | None = None) -> Column:
    """Asks for reasons in words first and then for the same scores."""
    return prompt(names, who, findings, REASONED + SCORES, prior)


def weight_prompt(names: Column, who: Column, finding: Column, kind: str = "numeric") -> Column:
    """Asks what a single finding says about every candidate, without any other finding, so that no order can matter.

    kind: numeric, logodds or ordinal.
    """
    ask = WEIGHTS[kind].replace("{labels}", ", ".join(ORDINAL_BANDS)) + WEIGHT_ANSWER
    return prompt(names, who, F.concat(F.lit("The only finding that is known: "), finding), ask)


def top_prompt(names: Column, who: Column, findings: Column) -> Column:
    """Asks for the number of the likeliest candidate alone."""
    return prompt(names, who, findings, TOP_ANSWER)
