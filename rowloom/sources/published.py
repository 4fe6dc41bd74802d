"""Variables, responses and level counts of the published tables."""

from __future__ import annotations

from rowloom.cards import REST

# Names in their published order. ``levels`` is one number for all categorical variables or one for each.
# Three tables have over two hundred variables of one kind; those are the columns that no other list names.
CARDS = {
    "xor_blobs": {
        "cat": ["c"],
        "num": ["x", "y"],
        "levels": 2,
    },
    "compas": {
        "cat": [
            "sex", "race_African-American", "race_Caucasian", "c_charge_degree_F", "c_charge_degree_M",
            "twoyearrecid", "age_cat_25-45", "age_cat_Greaterthan45", "age_cat_Lessthan25",
        ],
        "num": ["age", "juv_misd_count", "priors_count"],
        "response": "twoyearrecid",
        "levels": 2,
    },
    "electricity": {
        "cat": ["day", "class"],
        "num": ["date", "period", "nswprice", "nswdemand", "vicprice", "vicdemand", "transfer"],
        "response": "class",
        "levels": [7, 2],
    },
    "eye_movements": {
        "cat": ["P1stFixation", "P2stFixation", "nextWordRegress", "label"],
        "num": [
            "lineNo", "assgNo", "prevFixDur", "firstfixDur", "firstPassFixDur", "nextFixDur", "firstSaccLen",
            "lastSaccLen", "prevFixPos", "landingPos", "leavingPos", "totalFixDur", "meanFixDur", "regressLen",
            "regressDur", "pupilDiamMax", "pupilDiamLag", "timePrtctg", "titleNo", "wordNo",
        ],
        "response": "label",
        "levels": 2,
    },
    "covertype": {
        "cat": ["Y"],
        "num": ["X1", "X2", "X3", "X4", "X5", "X6", "X7", "X8", "X9", "X10"],
        "response": "Y",
        "levels": 2,
    },
    "telescope": {
        "cat": ["class"],
        "num": [
            "fLength:", "fWidth:", "fSize:", "fConc:", "fConc1:", "fAsym:", "fM3Long:", "fM3Trans:", "fAlpha:",
            "fDist:",
        ],
        "response": "class",
        "levels": 2,
    },
    "diabetes": {
        "cat": ["readmitted"],
        "num": [
            "time_in_hospital", "num_lab_procedures", "num_medications", "number_outpatient", "number_emergency",
            "number_inpatient", "number_diagnoses",
        ],
        "response": "readmitted",
        "levels": 2,
    },
    "credit": {
        "cat": ["SeriousDlqin2yrs"],
        "num": [
            "RevolvingUtilizationOfUnsecuredLines", "age", "NumberOfTime30-59DaysPastDueNotWorse", "DebtRatio",
            "MonthlyIncome", "NumberOfOpenCreditLinesAndLoans", "NumberOfTimes90DaysLate",
            "NumberRealEstateLoansOrLines", "NumberOfTime60-89DaysPastDueNotWorse", "NumberOfDependents",
        ],
        "response": "SeriousDlqin2yrs",
        "levels": 2,
    },
    "california": {
        "cat": ["price_above_median"],
        "num": ["MedInc", "HouseAge", "AveRooms", "AveBedrms", "Population", "AveOccup", "Latitude", "Longitude"],
        "response": "price_above_median",
        "levels": 2,
    },
    "heloc": {
        "cat": ["RiskPerformance"],
        "num": [
            "ExternalRiskEstimate", "MSinceOldestTradeOpen", "MSinceMostRecentTradeOpen", "AverageMInFile",
            "NumSatisfactoryTrades", "NumTrades60Ever2DerogPubRec", "NumTrades90Ever2DerogPubRec",
            "PercentTradesNeverDelq", "MSinceMostRecentDelq", "MaxDelq2PublicRecLast12M", "NumTotalTrades",
            "NumTradesOpeninLast12M", "PercentInstallTrades", "MSinceMostRecentInqexcl7days", "NumInqLast6M",
            "NumInqLast6Mexcl7days", "NetFractionRevolvingBurden", "NetFractionInstallBurden",
            "NumRevolvingTradesWBalance", "NumInstallTradesWBalance", "NumBank2NatlTradesWHighUtilization",
            "PercentTradesWBalance",
        ],
        "response": "RiskPerformance",
        "levels": 2,
    },
    "diamonds": {
        "cat": ["cut", "color"],
        "num": ["carat", "clarity", "depth", "table", "x", "y", "z", "price"],
        "response": "price",
        "levels": [5, 7],
    },
    "house_sales": {
        "cat": ["waterfront"],
        "num": [
            "bedrooms", "bathrooms", "sqft_living", "sqft_lot", "grade", "sqft_above", "sqft_basement", "yr_built",
            "lat", "long", "sqft_living15", "price",
        ],
        "response": "price",
        "levels": 2,
    },
    "bike_sharing": {
        "cat": ["month", "hour"],
        "num": ["temp", "feel_temp", "humidity", "windspeed", "count"],
        "response": "count",
        "levels": [12, 24],
    },
    "road_safety": {
        "cat": [
            "Vehicle_Reference_df_res", "Vehicle_Type", "Vehicle_Manoeuvre", "Vehicle_Location-Restricted_Lane",
            "Hit_Object_in_Carriageway", "Hit_Object_off_Carriageway", "Was_Vehicle_Left_Hand_Drive?",
            "Propulsion_Code", "Local_Authority_(District)", "Urban_or_Rural_Area", "Vehicle_Reference_df",
            "Casualty_Reference", "Sex_of_Casualty", "Pedestrian_Location", "Pedestrian_Movement", "Casualty_Type",
            "SexofDriver",
        ],
        "num": [
            "Age_of_Driver", "Age_Band_of_Driver", "Engine_Capacity_(CC)", "Age_of_Vehicle", "Longitude", "Latitude",
            "Police_Force", "Number_of_Vehicles", "Age_of_Casualty", "Age_Band_of_Casualty", "Casualty_IMD_Decile",
        ],
        "response": "SexofDriver",
        "levels": [32, 15, 18, 10, 12, 12, 2, 8, 324, 2, 23, 35, 2, 11, 10, 21, 2],
    },
    "brazilian_houses": {
        "cat": ["city", "area", "animal", "furniture"],
        "num": [
            "rooms", "bathroom", "parking_spaces", "hoa_(BRL)", "rent_amount_(BRL)", "property_tax_(BRL)",
            "fire_insurance_(BRL)", "total_(BRL)",
        ],
        "response": "total_(BRL)",
        "levels": [5, 517, 2, 2],
    },
    "abalone": {
        "cat": ["Sex"],
        "num": [
            "Length", "Diameter", "Height", "Whole_weight", "Shucked_weight", "Viscera_weight", "Shell_weight",
            "Classnumberofrings",
        ],
        "response": "Classnumberofrings",
        "levels": 3,
    },
    "supreme": {
        "cat": ["Liberal", "Unconstitutional", "Precedent_alteration", "Unanimous", "Lower_court_disagreement"],
        "num": ["Actions_taken", "Year_of_decision", "Log_exposure"],
        "response": "Log_exposure",
        "levels": 2,
    },
    "seattle_crime": {
        "cat": ["Precinct", "Sector", "Occurred_hour", "Occurred_min"],
        "num": ["ReportedTime"],
        "response": "ReportedTime",
        "levels": [5, 17, 24, 24],
    },
    "superconduct": {
        "num": [
            "mean_atomic_mass", "wtd_mean_atomic_mass", "gmean_atomic_mass", "wtd_gmean_atomic_mass",
            "entropy_atomic_mass", "wtd_entropy_atomic_mass", "range_atomic_mass", "wtd_range_atomic_mass",
            "std_atomic_mass", "wtd_std_atomic_mass", "mean_fie", "wtd_mean_fie", "gmean_fie", "wtd_gmean_fie",
            "entropy_fie", "wtd_entropy_fie", "range_fie", "wtd_range_fie", "std_fie", "wtd_std_fie",
            "mean_atomic_radius", "wtd_mean_atomic_radius", "gmean_atomic_radius", "wtd_gmean_atomic_radius",
            "entropy_atomic_radius", "wtd_entropy_atomic_radius", "range_atomic_radius", "wtd_range_atomic_radius",
            "std_atomic_radius", "wtd_std_atomic_radius", "mean_Density", "wtd_mean_Density", "gmean_Density",
            "wtd_gmean_Density", "entropy_Density", "wtd_entropy_Density", "range_Density", "wtd_range_Density",
            "std_Density", "wtd_std_Density", "mean_ElectronAffinity", "wtd_mean_ElectronAffinity",
            "gmean_ElectronAffinity", "wtd_gmean_ElectronAffinity", "entropy_ElectronAffinity",
            "wtd_entropy_ElectronAffinity", "range_ElectronAffinity", "wtd_range_ElectronAffinity",
            "std_ElectronAffinity", "wtd_std_ElectronAffinity", "mean_FusionHeat", "wtd_mean_FusionHeat",
            "gmean_FusionHeat", "wtd_gmean_FusionHeat", "entropy_FusionHeat", "wtd_entropy_FusionHeat",
            "range_FusionHeat", "wtd_range_FusionHeat", "std_FusionHeat", "wtd_std_FusionHeat",
            "mean_ThermalConductivity", "wtd_mean_ThermalConductivity", "gmean_ThermalConductivity",
            "wtd_gmean_ThermalConductivity", "entropy_ThermalConductivity", "wtd_entropy_ThermalConductivity",
            "range_ThermalConductivity", "wtd_range_ThermalConductivity", "std_ThermalConductivity",
            "wtd_std_ThermalConductivity", "mean_Valence", "wtd_mean_Valence", "gmean_Valence", "wtd_gmean_Valence",
            "entropy_Valence", "wtd_entropy_Valence", "wtd_range_Valence", "std_Valence", "wtd_std_Valence",
            "criticaltemp",
        ],
        "response": "criticaltemp",
    },
    "wine_quality": {
        "num": [
            "fixed_acidity", "volatile_acidity", "citric_acid", "residual_sugar", "chlorides", "free_sulfur_dioxide",
            "total_sulfur_dioxide", "density", "pH", "sulphates", "alcohol", "quality",
        ],
        "response": "quality",
    },
    "medical_charges": {
        "num": [
            "Total_Discharges", "Average_Covered_Charges", "Average_Medicare_Payments", "AverageTotalPayments",
        ],
        "response": "AverageTotalPayments",
    },
    "jannis": {
        "cat": ["class"],
        "num": [
            "V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V11", "V12", "V13", "V14", "V15", "V16",
            "V17", "V18", "V19", "V20", "V21", "V22", "V23", "V24", "V25", "V26", "V27", "V28", "V29", "V30", "V31",
            "V32", "V33", "V34", "V35", "V36", "V37", "V38", "V39", "V40", "V41", "V42", "V43", "V44", "V45", "V46",
            "V47", "V48", "V49", "V50", "V51", "V52", "V53", "V54",
        ],
        "response": "class",
        "levels": 2,
    },
    "defaults": {
        "cat": ["x2", "y"],
        "num": [
            "x1", "x5", "x6", "x7", "x8", "x9", "x10", "x11", "x12", "x13", "x14", "x15", "x16", "x17", "x18", "x19",
            "x20", "x21", "x22", "x23",
        ],
        "response": "y",
        "levels": 2,
    },
    "bioresponse": {
        "cat": ["target"],
        "num": [REST],
        "response": "target",
        "levels": 2,
    },
    "allstate": {
        "cat": [
            "cat1", "cat2", "cat3", "cat4", "cat5", "cat6", "cat7", "cat8", "cat9", "cat10", "cat11", "cat12",
            "cat13", "cat14", "cat15", "cat16", "cat17", "cat18", "cat19", "cat20", "cat21", "cat22", "cat23",
            "cat24", "cat25", "cat26", "cat27", "cat28", "cat29", "cat30", "cat31", "cat32", "cat33", "cat34",
            "cat35", "cat36", "cat37", "cat38", "cat39", "cat40", "cat41", "cat42", "cat43", "cat44", "cat45",
            "cat46", "cat47", "cat48", "cat49", "cat50", "cat51", "cat52", "cat53", "cat54", "cat55", "cat56",
            "cat57", "cat58", "cat59", "cat60", "cat61", "cat62", "cat63", "cat64", "cat65", "cat66", "cat67",
            "cat68", "cat69", "cat70", "cat71", "cat72", "cat73", "cat74", "cat75", "cat76", "cat77", "cat78",
            "cat79", "cat80", "cat81", "cat82", "cat83", "cat84", "cat85", "cat86", "cat87", "cat88", "cat89",
            "cat90", "cat91", "cat92", "cat93", "cat94", "cat95", "cat96", "cat97", "cat98", "cat99", "cat100",
            "cat101", "cat102", "cat103", "cat104", "cat105", "cat106", "cat107", "cat108", "cat111", "cat114",
        ],
        "num": [
            "cont1", "cont2", "cont3", "cont4", "cont5", "cont6", "cont7", "cont8", "cont9", "cont10", "cont11",
            "cont12", "cont13", "cont14", "loss",
        ],
        "response": "loss",
        "levels": [
            2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2,
            2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2,
            2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 8, 7, 8, 7, 5, 7, 5, 8, 7, 5, 16, 15, 19, 9, 13,
            17, 20, 17, 20, 11, 16, 19,
        ],
    },
    "mercedes": {
        "cat": [REST],
        "num": ["y"],
        "response": "y",
    },
    "sgemm": {
        "cat": ["KWG", "KWI", "STRM", "STRN", "SA", "SB"],
        "num": ["Run2", "Run3", "Run4", "Run1"],
        "response": "Run1",
        "levels": 2,
    },
    "topo": {
        "cat": ["oz265", "oz260", "oz256"],
        "num": [REST, "oz267"],
        "response": "oz267",
        "levels": 2,
    },
    "ailerons": {
        "num": [
            "climbRate", "Sgz", "p", "q", "curPitch", "curRoll", "absRoll", "diffClb", "diffRollRate", "diffDiffClb",
            "SeTime1", "SeTime2", "SeTime3", "SeTime4", "SeTime5", "SeTime6", "SeTime7", "SeTime8", "SeTime9",
            "SeTime10", "SeTime11", "SeTime12", "SeTime13", "SeTime14", "diffSeTime1", "diffSeTime3", "diffSeTime5",
            "diffSeTime7", "diffSeTime9", "diffSeTime11", "diffSeTime13", "alpha", "Se", "goal",
        ],
        "response": "goal",
    },
    "miami_housing": {
        "num": [
            "LATITUDE", "LONGITUDE", "LND_SQFOOT", "TOT_LVG_AREA", "SPEC_FEAT_VAL", "RAIL_DIST", "OCEAN_DIST",
            "WATER_DIST", "CNTR_DIST", "SUBCNTR_DI", "HWY_DIST", "age", "month_sold", "SALEPRC",
        ],
        "response": "SALEPRC",
    },
    "cpu": {
        "num": [
            "lread", "lwrite", "scall", "sread", "swrite", "fork", "exec", "rchar", "wchar", "pgout", "ppgout",
            "pgfree", "pgscan", "atch", "pgin", "ppgin", "pflt", "vflt", "runqsz", "freemem", "freeswap", "usr",
        ],
        "response": "usr",
    },
    "elevators": {
        "num": [
            "climbRate", "Sgz", "p", "q", "curRoll", "absRoll", "diffClb", "diffRollRate", "diffDiffClb", "SaTime1",
            "SaTime2", "SaTime3", "SaTime4", "diffSaTime1", "diffSaTime3", "Sa", "Goal",
        ],
        "response": "Goal",
    },
    "house": {
        "num": [
            "P1", "P5p1", "P6p2", "P11p4", "P14p9", "P15p1", "P15p3", "P16p2", "P18p2", "P27p4", "H2p2", "H8p2",
            "H10p1", "H13p1", "H18pA", "H40p4", "price",
        ],
        "response": "price",
    },
    "houses": {
        "num": [
            "median_income", "housing_median_age", "total_rooms", "total_bedrooms", "population", "households",
            "latitude", "longitude", "medianhousevalue",
        ],
        "response": "medianhousevalue",
    },
    "pol": {
        "num": [
            "f5", "f6", "f7", "f8", "f9", "f13", "f14", "f15", "f16", "f17", "f18", "f19", "f20", "f21", "f22",
            "f23", "f24", "f25", "f26", "f27", "f28", "f29", "f30", "f31", "f32", "f33", "foo",
        ],
        "response": "foo",
    },
    "sulfur": {
        "num": ["a1", "a2", "a3", "a4", "a5", "y2", "y1"],
        "response": "y1",
    },
    "miniboone": {
        "cat": ["signal"],
        "num": [
            "ParticleID_0", "ParticleID_1", "ParticleID_2", "ParticleID_3", "ParticleID_4", "ParticleID_5",
            "ParticleID_6", "ParticleID_7", "ParticleID_8", "ParticleID_9", "ParticleID_10", "ParticleID_11",
            "ParticleID_12", "ParticleID_13", "ParticleID_14", "ParticleID_15", "ParticleID_16", "ParticleID_17",
            "ParticleID_18", "ParticleID_19", "ParticleID_20", "ParticleID_21", "ParticleID_22", "ParticleID_23",
            "ParticleID_24", "ParticleID_25", "ParticleID_26", "ParticleID_27", "ParticleID_28", "ParticleID_29",
            "ParticleID_30", "ParticleID_31", "ParticleID_32", "ParticleID_33", "ParticleID_34", "ParticleID_35",
            "ParticleID_36", "ParticleID_37", "ParticleID_38", "ParticleID_39", "ParticleID_40", "ParticleID_41",
            "ParticleID_42", "ParticleID_43", "ParticleID_44", "ParticleID_45", "ParticleID_46", "ParticleID_47",
            "ParticleID_48", "ParticleID_49",
        ],
        "response": "signal",
        "levels": 2,
    },
    "bank_marketing": {
        "cat": ["Class"],
        "num": ["V1", "V6", "V10", "V12", "V13", "V14", "V15"],
        "response": "Class",
        "levels": 2,
    },
    "yprop": {
        "num": [
            "oz1", "oz2", "oz3", "oz4", "oz5", "oz6", "oz9", "oz10", "oz11", "oz12", "oz13", "oz31", "oz83", "oz87",
            "oz124", "oz125", "oz126", "oz127", "oz128", "oz131", "oz133", "oz149", "oz150", "oz151", "oz165",
            "oz171", "oz172", "oz173", "oz175", "oz176", "oz177", "oz178", "oz181", "oz183", "oz185", "oz197",
            "oz246", "oz247", "oz248", "oz249", "oz250", "oz251", "oz252",
        ],
        "response": "oz252",
    },
    "ukair": {
        "cat": ["Hour", "Month", "DayofWeek", "Environment_Type"],
        "num": [
            "Altitude_m", "PM_sub_2_5_sub_particulate_matter_Hourly_measured",
            "PM_sub_10_sub_particulate_matter_Hourly_measured",
        ],
        "response": "PM_sub_10_sub_particulate_matter_Hourly_measured",
        "levels": [24, 12, 7, 4],
    },
    "albert": {
        "cat": [
            "V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V11", "V13", "V19", "V22", "V30", "V33",
            "V35", "V36", "V40", "V41", "V42", "V43", "V45", "V47", "V50", "V51", "V52", "V59", "V63", "V72", "V75",
            "class",
        ],
        "response": "class",
        "levels": [
            150, 2083, 575, 85, 6589, 1326, 715, 52, 1673, 9, 104, 145, 10, 3, 8, 4, 10, 13, 580, 4, 79, 1526, 9, 11,
            593, 95, 8, 605, 14, 90, 91, 2,
        ],
    },
    "airlines": {
        "cat": ["Month", "DayofMonth"],
        "num": ["CRSDepTime", "CRSArrTime", "Distance", "DepDelay"],
        "response": "DepDelay",
        "levels": [12, 31],
    },
    "higgs": {
        "cat": ["target"],
        "num": [
            "lepton_pT", "lepton_eta", "lepton_phi", "missing_energy_magnitude", "missing_energy_phi", "jet_1_pt",
            "jet_1_eta", "jet_1_phi", "jet_2_pt", "jet_2_eta", "jet_2_phi", "jet_3_pt", "jet_3_eta", "jet_3_phi",
            "jet_4_pt", "jet_4_eta", "jet_4_phi", "m_jj", "m_jjj", "m_lv", "m_jlv", "m_bb", "m_wbb", "m_wwbb",
        ],
        "response": "target",
        "levels": 2,
    },
    "nyc_taxi": {
        "cat": [
            "VendorID", "store_and_fwd_flag", "RatecodeID", "extra", "mta_tax", "improvement_surcharge", "trip_type",
            "lpep_pickup_datetime_day", "lpep_pickup_datetime_hour", "lpep_pickup_datetime_minute",
            "lpep_dropoff_datetime_day", "lpep_dropoff_datetime_hour", "lpep_dropoff_datetime_minute",
        ],
        "num": ["passenger_count", "tolls_amount", "total_amount", "tip_amount"],
        "response": "tip_amount",
        "levels": [2, 2, 5, 5, 3, 3, 2, 31, 24, 60, 31, 24, 60],
    },
    "soil": {
        "cat": ["isns"],
        "num": ["northing", "easting", "resistivity", "track"],
        "response": "track",
        "levels": 2,
    },
    "kickstarter": {
        "txt": ["name", "desc", "keywords"],
        "cat": ["disable_communication", "country", "currency", "final_status"],
        "num": ["goal", "deadline", "created_at"],
        "response": "final_status",
        "levels": [2, 10, 9, 2],
    },
    "clothing": {
        "txt": ["Title", "Review Text"],
        "cat": ["Recommended IND", "Division Name", "Department Name", "Class Name", "Rating"],
        "num": ["Age", "Positive Feedback Count"],
        "response": "Rating",
        "levels": [2, 4, 7, 21, 5],
    },
    "streetview": {
        "dense": ["image"],
        "cat": ["country_iso_alpha2"],
        "num": ["latitude", "longitude"],
        "response": "country_iso_alpha2",
        "levels": 56,
    },
    "skin_cancer": {
        "dense": ["image"],
        "cat": ["dx", "dx_type", "sex", "localization"],
        "num": ["age"],
        "response": "dx",
        "levels": [7, 4, 3, 15],
    },
}
