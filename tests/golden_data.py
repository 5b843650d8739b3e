"""The labelled stories and questions behind the published retrieval figures.

They are test data, given as plain text in their natural order."""

# (document id, story id, title, text)
STORIES = [
    ("demo-story-1", "demo-research",
     "Aster Mobility opens a battery research centre in Chennai",
     "Aster Mobility announced a battery research centre in Chennai on September 6. The company said the facility would focus on thermal safety testing and employ 120 researchers over two years. The hiring figure is a company target, not a verified headcount."),
    ("demo-story-2", "demo-research",
     "Chennai battery centre planned by Aster Mobility",
     "Aster Mobility announced a battery research centre in Chennai on September 6. The company said the facility would focus on thermal safety testing and employ 120 researchers over two years. This article repeats the company's announcement without additional reporting."),
    ("demo-story-3", "demo-story-3",
     "ஆஸ்டர் மொபிலிட்டி தொழிற்சாலை அருகே நீர் பயன்பாடு குறித்து கேள்வி",
     "ஆஸ்டர் மொபிலிட்டி தொழிற்சாலை அருகே வசிக்கும் மக்கள் நீர் பயன்பாடு குறித்து விளக்கம் கேட்டுள்ளனர். நிறுவனம் அடுத்த மாதம் நீர் பயன்பாட்டு அறிக்கையை வெளியிடுவதாக தெரிவித்துள்ளது. விதிமீறல் நடந்ததாக இந்த செய்தி உறுதி செய்யவில்லை."),
    ("demo-story-4", "demo-story-4",
     "Aster Mobility reports revenue growth alongside higher costs",
     "Aster Mobility reported an 18 percent increase in quarterly revenue. Operating costs rose 22 percent in the same period. The company attributed the cost increase to its research programme and new service locations. The release did not disclose profitability for individual products."),
    ("demo-story-5", "demo-story-5",
     "Aster Mobility recalls one charger batch for inspection",
     "Aster Mobility issued a voluntary recall of 800 chargers after identifying a connector fault in one production batch. The company said affected customers would receive replacements at no cost. No injuries were reported in the announcement."),
    ("demo-story-6", "demo-story-6",
     "European distributor signs pilot agreement with Aster Mobility",
     "Aster Mobility signed a six-month pilot agreement with a European distributor. The pilot will test service logistics in two cities before either party decides on a wider rollout. No binding volume commitment was disclosed."),
    ("demo-story-7", "demo-story-7",
     "Local suppliers join Aster Mobility skills programme",
     "Aster Mobility and a local training institute announced a supplier skills programme in Tamil Nadu. The first cohort will cover quality checks and maintenance. The announcement did not specify the number of suppliers who had enrolled."),
    ("demo-story-8", "demo-story-8",
     "Aster Mobility appoints a new head of service operations",
     "Aster Mobility appointed a new head of service operations. The company said the role would coordinate service capacity across its existing locations. The announcement did not include new performance targets."),
]

# prewritten translation of the one story that is not in English
TRANSLATIONS = {
    "demo-story-3": "Residents near Aster Mobility's factory have asked for information about water use. The company said it would publish a water-use report next month. This report does not establish that a violation occurred.",
}

# (question id, text, relevant story ids)
QUESTIONS = [
    ("q01", "battery research thermal safety", ["demo-research"]),
    ("q02", "researchers hiring centre", ["demo-research"]),
    ("q03", "water use residents factory", ["demo-story-3"]),
    ("q04", "நீர் பயன்பாடு தொழிற்சாலை", ["demo-story-3"]),
    ("q05", "revenue operating costs quarterly", ["demo-story-4"]),
    ("q06", "profitability individual products", ["demo-story-4"]),
    ("q07", "charger connector fault recall", ["demo-story-5"]),
    ("q08", "customers replacement injuries", ["demo-story-5"]),
    ("q09", "European distributor pilot agreement", ["demo-story-6"]),
    ("q10", "binding volume commitment rollout", ["demo-story-6"]),
    ("q11", "supplier skills training institute", ["demo-story-7"]),
    ("q12", "quality checks maintenance cohort", ["demo-story-7"]),
    ("q13", "head service operations appointment", ["demo-story-8"]),
    ("q14", "service capacity performance targets", ["demo-story-8"]),
    ("q15", "centre research and skills programme", ["demo-research", "demo-story-7"]),
    ("q16", "volcanic eruption forecast", []),
    ("q17", "football tournament scores", []),
    ("q18", "கிரிக்கெட் போட்டி முடிவுகள்", []),
]

# mode -> (recall at 5, mean reciprocal rank, abstention)
EXPECTED = {"original": (0.933, 0.933, 1.0), "translated": (1.0, 1.0, 1.0)}
