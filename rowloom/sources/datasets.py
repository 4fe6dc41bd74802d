"""The published benchmark tables: where each comes from, its variables, and its preparation steps."""

from __future__ import annotations

from rowloom.cards import REST, DataCard
from rowloom.plans.recipe import Recipe, Step, cast, clean, codes, log1p, log10, minmax, not_null, rename_map, sanitize
from rowloom.sources.published import CARDS
from rowloom.sources.tables import Dataset, Registry

KEY = "row_id"
TABULAR = "inria-soda/tabular-benchmark"
TEXT_WORDS = 200  # fixed value: words that the two published text recipes keep

# Places of the published tables; those without a slash are configurations of TABULAR.
ORIGINS = {
    "compas": "clf_cat_compas-two-years",
    "electricity": "clf_cat_electricity",
    "eye_movements": "clf_cat_eye_movements",
    "covertype": "clf_num_covertype",
    "telescope": "clf_num_MagicTelescope",
    "diabetes": "clf_num_Diabetes130US",
    "credit": "clf_num_credit",
    "california": "clf_num_california",
    "heloc": "clf_num_heloc",
    "diamonds": "reg_cat_diamonds",
    "house_sales": "reg_cat_house_sales",
    "bike_sharing": "reg_num_Bike_Sharing_Demand",
    "road_safety": "clf_cat_road-safety",
    "brazilian_houses": "reg_cat_Brazilian_houses",
    "abalone": "reg_cat_abalone",
    "supreme": "reg_cat_analcatdata_supreme",
    "seattle_crime": "reg_cat_seattlecrime6",
    "superconduct": "reg_num_superconduct",
    "wine_quality": "reg_num_wine_quality",
    "medical_charges": "reg_cat_medical_charges",
    "jannis": "clf_num_jannis",
    "defaults": "clf_cat_default-of-credit-card-clients",
    "bioresponse": "clf_num_Bioresponse",
    "allstate": "reg_cat_Allstate_Claims_Severity",
    "mercedes": "reg_cat_Mercedes_Benz_Greener_Manufacturing",
    "sgemm": "reg_cat_SGEMM_GPU_kernel_performance",
    "topo": "reg_cat_topo_2_1",
    "ailerons": "reg_num_Ailerons",
    "miami_housing": "reg_num_MiamiHousing2016",
    "cpu": "reg_num_cpu_act",
    "elevators": "reg_num_elevators",
    "house": "reg_num_house_16H",
    "houses": "reg_num_houses",
    "pol": "reg_num_pol",
    "sulfur": "reg_num_sulfur",
    "miniboone": "clf_num_MiniBooNE",
    "bank_marketing": "clf_num_bank-marketing",
    "yprop": "reg_num_yprop_4_1",
    "ukair": "reg_cat_particulate-matter-ukair-2017",
    "albert": "clf_cat_albert",
    "airlines": "reg_cat_Airlines_DepDelay_1M",
    "higgs": "clf_num_Higgs",
    "nyc_taxi": "reg_cat_nyc-taxi-green-dec-2016",
    "soil": "reg_cat_visualizing_soil",
    "kickstarter": "james-burton/kick_starter_funding",
    "clothing": "Censius-AI/ECommerce-Women-Clothing-Reviews",
    "streetview": "stochastic/random_streetview_images_pano_v0.0.2",
    "skin_cancer": "marmal88/skin_cancer",
    "xor_blobs": "generated/xor_blobs",
}

# The published preparation steps.
STEPS: dict[str, tuple[Step, ...]] = {
    "electricity": (codes("class"),),
    "covertype": (sanitize(), codes("Y"), minmax("X1", "X2", "X3", "X4", "X5", "X6", "X7", "X8", "X9", "X10")),
    "telescope": (codes("class"),),
    "house_sales": (codes("waterfront"),),
    "road_safety": (
        log10("Engine_Capacity_(CC)"), minmax("Location_Easting_OSGR", "Location_Northing_OSGR"), codes(*CARDS["road_safety"]["cat"]),
    ),
    "brazilian_houses": (
        log1p("hoa_(BRL)", "rent_amount_(BRL)", "property_tax_(BRL)", "fire_insurance_(BRL)", "total_(BRL)"), codes("area"),
    ),
    "wine_quality": (rename_map({
        "fixed.acidity": "fixed_acidity", "volatile.acidity": "volatile_acidity", "citric.acid": "citric_acid",
        "residual.sugar": "residual_sugar", "free.sulfur.dioxide": "free_sulfur_dioxide",
        "total.sulfur.dioxide": "total_sulfur_dioxide",
    }),),
    "medical_charges": (log10("Average_Covered_Charges", "Average_Medicare_Payments"),),
    "defaults": (
        log1p("x1", "x18", "x19", "x20", "x21", "x22", "x23"), minmax("x12", "x13", "x14", "x15", "x16", "x17"),
    ),
    "cpu": (log1p(
        "lread", "lwrite", "scall", "sread", "swrite", "fork", "exec", "rchar", "wchar", "pgout", "ppgout",
        "pgfree", "pgscan", "atch", "pgin", "ppgin", "pflt", "vflt", "runqsz", "freemem", "freeswap",
    ),),
    "house": (log1p("P1"),),
    "houses": (log10("total_rooms", "total_bedrooms", "population", "households"),),
    "miniboone": (codes("signal"), minmax("ParticleID_19")),
    "bank_marketing": (codes("Class"),),
    "ukair": (rename_map({
        "Environment.Type": "Environment_Type",
        "Altitude..m.": "Altitude_m",
        "PM.sub.2.5..sub..particulate.matter..Hourly.measured.": "PM_sub_2_5_sub_particulate_matter_Hourly_measured",
        "PM.sub.10..sub..particulate.matter..Hourly.measured.": "PM_sub_10_sub_particulate_matter_Hourly_measured",
    }),),
    "albert": (sanitize(), codes(REST, order="lexical")),
    "airlines": (
        sanitize(), codes("Month", "DayofMonth", order="lexical"), minmax("CRSDepTime", "CRSArrTime", "Distance", "DepDelay"),
    ),
    "higgs": (sanitize(), codes("target"), minmax(*CARDS["higgs"]["num"])),
    "nyc_taxi": (sanitize(), codes(*CARDS["nyc_taxi"]["cat"], order="lexical"), minmax(*CARDS["nyc_taxi"]["num"])),
    "soil": (sanitize(), codes("isns"), minmax("northing", "easting", "resistivity", "track")),
    "kickstarter": (
        cast("double", "goal", "deadline", "created_at"), log10("goal"), minmax("goal", "deadline", "created_at", train_only=True),
        clean("name", "desc", "keywords", max_words=TEXT_WORDS),
        codes("disable_communication", "country", "currency", train_only=True),
    ),
    "clothing": (
        clean("Title", "Review Text", max_words=TEXT_WORDS),
        codes("Recommended IND", "Division Name", "Department Name", "Class Name", "Rating"),
    ),
    "streetview": (cast("double", "latitude", "longitude"), minmax("latitude", "longitude"), codes("country_iso_alpha2")),
    "skin_cancer": (not_null("age"), codes("dx", "dx_type", "sex", "localization", train_only=True)),
}
PRESPLIT = ("kickstarter", "skin_cancer", "xor_blobs")


def _dataset(name: str) -> Dataset:
    origin = ORIGINS[name]
    return Dataset(DataCard(key=KEY, **CARDS[name]), Recipe(STEPS.get(name, ())), name in PRESPLIT, origin if "/" in origin else f"{TABULAR}:{origin}")


DATASETS = Registry({name: _dataset(name) for name in ORIGINS})
