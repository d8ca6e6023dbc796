"""Prompts that ask a model for a product's sustainability score and for search criteria."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of both prompts; <names> are filled per row.
NO_KEYWORDS = "Aucun"
NO_QUERY = "Aucune requête spécifique"
NO_HISTORY = "Aucun historique disponible"
HISTORY_TITLES = 5
ECO_PROMPT = """Tu es un expert en durabilité et éco-responsabilité produit.

Évalue ce produit de 0 à 10 en termes de durabilité réelle (et pas juste greenwashing).

Critères pris en compte :

- Matériaux recyclés, biosourcés, certifiés (GOTS, OEKO-TEX, etc.)

- Empreinte carbone de fabrication et transport

- Durabilité et réparabilité

- Certifications officielles

- Politique de la marque (B-Corp, 1% for the Planet, etc.)

- Avis clients mentionnant la longévité ou l'éthique

Réponds EXACTEMENT avec ce format (rien d'autre) :

{"sustainability_score": 8.7, "short_reason": "Cuir de pomme recyclé, marque B-Corp, fabriqué en Italie, réparable à vie"}

Produit :

Titre : <title>

Description : <description>

Marque : <brand>

Caractéristiques : <features>

Mots-clés détectés : <keywords>
"""
CRITERIA_PROMPT = """Tu es un expert en shopping personnalisé ultra-précis.

À partir de cette requête utilisateur (ou historique d'achats), génère 8 à 12 critères de recherche très précis et variés que l'utilisateur recherche implicitement.

Réponds EXACTEMENT sous ce format JSON (rien d'autre, pas de ```json) :

{
  "expanded_criteria": [
    "critère 1",
    "critère 2",
    ...
  ]
}

Requête utilisateur : "<query>"

Historique récent (si disponible) : <history>
"""


def _filled(template: str, **values: Column) -> Column:
    """The template with each `<name>` replaced by its column; nulls count as ''."""
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split(f"<{name}>", 1)
        parts += [F.lit(before), F.coalesce(value, F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def eco_prompt(title: Column, description: Column, brand: Column, features: Column, keywords: Column) -> Column:
    """`keywords` is the array of found keywords."""
    found = F.when(F.size(keywords) > 0, F.array_join(keywords, ", ")).otherwise(F.lit(NO_KEYWORDS))
    return _filled(
        ECO_PROMPT, title=title, description=description, brand=brand, features=features, keywords=found
    )


def criteria_prompt(query: Column, titles: Column) -> Column:
    """`titles` is the array of history titles in order; the first five are listed."""
    listed = F.transform(F.slice(titles, 1, HISTORY_TITLES), lambda t: F.concat(F.lit("- "), t))
    history = F.when(F.size(titles) > 0, F.array_join(listed, "\n")).otherwise(F.lit(NO_HISTORY))
    asked = F.when(query != "", query).otherwise(F.lit(NO_QUERY))
    return _filled(CRITERIA_PROMPT, query=asked, history=history)
