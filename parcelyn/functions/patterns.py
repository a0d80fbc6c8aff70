"""Fixed values of text mining: ordered patterns by key, which results depend on."""

# Fixed values. Metrics: the first pattern that matches decides.
METRICS = {
    "size_sqm": [
        r"(?:total\s+builded\s+area|built\s+area|building\s+area)\s*(?:in\s+m2)?\s*[\s:\-=>]*\s*([\d][\d,.\s\xa0]*[\d])",
        r"(?:area|size|internal area|total size|living space|εμβαδόν|χώρος|επιφάνεια|καθαρά τ\.μ\.)\s*[\s:\-=>]*\s*([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|square meters?|τ\.μ\.|τμ)?",
        r"([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|square meters?|τ\.μ\.|τμ)\s*[\s:\-=>]*\s*(?:total|area|size|εμβαδόν|επιφάνεια)",
        r"(?:sized at|covering|επιφάνειας)\s*([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)",
        r"\b([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)\b",
        r"(?:villas?|βίλ[αες]|apartments?|διαμέρισμα|maisonettes?|μεζονέτα|house|μονοκατοικία)\s*[\s:\-=>|/]*\s*([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)",
        r"([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)\s*[\s:\-=>|/]*\s*(?:villas?|βίλ[αες]|apartments?|διαμέρισμα|maisonettes?|μεζονέτα|house|μονοκατοικία)",
    ],
    "land_size_sqm": [
        r"(?:land\s+size|land\s+plot)\s*(?:in\s+m2)?\s*[\s:\-=>]*\s*([\d][\d,.\s\xa0]*[\d])",
        r"(?:plot(?: size)?|land(?: size)?|lot|garden|οικόπεδο|αγροτεμάχιο|έκταση)\s*[\s:\-=>]*\s*([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)?",
        r"([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)\s*(?:of\s+)?(?:land|plot|garden|οικόπεδο|αγροτεμάχιο)",
        r"(?:set on|situated on|σε οικόπεδο)\s+(?:a\s+|over\s+)?([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)?",
    ],
    "bedrooms": [
        r"\b(\d+)\s*[\s:\-]*\s*(?:bedrooms?|beds?|br|bds?|υπνοδωμάτια|υπνοδωμάτιο|υ/δ|υδ|υπν\.?)\b",
        r"(?:bedrooms?|beds?|br|bds?|υπνοδωμάτια|υπνοδωμάτιο|υ/δ|υδ|υπν\.?)\s*[\s:\-=>]*\s*(\d+)",
        r"(?:consists of|featuring|has|offers|διαθέτει|αποτελείται από)\s*(\d+)\s*(?:bedrooms?|beds?|υ/δ|υπνοδωμάτια)"
    ],
    "bathrooms": [
        r"\b(\d+)\s*[\s:\-]*\s*(?:bathrooms?|baths?|ba|μπάνια|μπάνιο|λουτρά|wc)\b",
        r"(?:bathrooms?|baths?|ba|μπάνια|μπάνιο|λουτρά|wc)\s*[\s:\-=>]*\s*(\d+)",
        r"(?:and|with|με)\s*(\d+)\s*(?:bathrooms?|baths?|μπάνια|λουτρά|wc)"
    ],
    "levels": [
        r"(?:levels?|floors?|storeys?|επίπεδα|επίπεδο|όροφοι)\s*[\s:\-=>]*\s*(\d+)",
        r"(\d+)\s*[- ]*\s*(?:levels?|storey|floors?|επίπεδα|επίπεδο|όροφοι)",
        r"(?:across|over|on|in|σε)\s+(\d+)\s+(?:levels?|floors?|επίπεδα|ορόφους)",
        r"(?:no\.?\s+of\s+(?:levels|floors)|number\s+of\s+(?:levels|floors))\s*(?:\(floors\))?\s*[\s:\-=>]*\s*(\d+)",
    ],
    "year_built": [
        r"(?:built|constructed|construction year|year built|έτος κατασκευής|κατασκευής)\s*[\s:\-=>]*\s*(19\d{2}|20\d{2})",
        r"(?:built in|constructed in|completed in|κατασκευάστηκε το|το έτος)\s*(19\d{2}|20\d{2})",
        r"\b(19[5-9]\d|20[0-2]\d)\b",
        r"(?:built\s+in\s*/\s*year|year\s+of\s+construction)\s*[\s:\-=>]*\s*(19\d{2}|20\d{2})",
    ],
    "distance_to_sea": [
        r"(?:distance(?: to sea)?|to the beach|from the sea|from beach|απόσταση(?: από θάλασσα)?|από την παραλία)\s*[\s:\-=>]*\s*([\d,.]+)\s*(?:m|meters?|km|kilometers?|μ\.?|μέτρα|χλμ)",
        r"([\d,.]+)\s*(?:m|meters?|km|μ\.?|μέτρα|χλμ)\s*(?:from|to|από)\s*(?:the\s+)?(?:sea|beach|coast|θάλασσα|παραλία)",
        r"(?:only|just|μόλις)\s*([\d,.]+)\s*(?:m|meters?|km|μ\.?|μέτρα|χλμ)\s*(?:away|από)?",
        r"(?:beachfront\s+location[\s\-—–]*)([\d,.]+)\s*(?:m|meters?|μ)\s*(?:from\s+the\s+sea)?",
    ],
    "pool_size_sqm": [
        r"\b([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)\s*(?:swimming\s+)?pool\b",
        r"\bpool\s*(?:size)?\s*(?:of)?\s*[\s:\-=>]*\s*([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²)",
        r"\b(?:swimming\s+pool|πισίνα)\s+(?:of\s+)?([\d,.]+)\s*(?:sqm|sq\.?m|m2|m²|τ\.μ\.|τμ)",
    ],
    "parking_count": [
        r"\b(\d+)\s+(?:covered\s+)?(?:parking\s+(?:lots?|spots?|spaces?|places?)|θέσεις\s+(?:στάθμευσης|πάρκινγκ))",
        r"(?:parking|στάθμευση|πάρκινγκ)\s*[\s:\-=>]*\s*(\d+)\s*(?:lots?|spots?|spaces?|θέσε[ιω]ς)?",
        r"\b(\d+)\s+(?:private|covered|outdoor|underground|indoor|reserved)\s+parking\b",
        r"\bparking\s+for\s+(\d+)\s+(?:cars?|vehicles?|αυτοκίνητα)\b",
    ],
    "elevator_count": [
        r"(?:no\.?\s+of\s+elevators?|number\s+of\s+elevators?)\s*[\s:\-=>]*\s*(\d+)",
        r"\b(\d+)\s+elevators?\b",
    ],
    "buildings_count": [
        r"(?:no\.?\s+of\s+buildings?|number\s+of\s+buildings?)\s*[\s:\-=>]*\s*(\d+)",
        r"\b(\d+)\s+buildings?\b(?!\s*area)",  # not the area of buildings
    ],
    "rooms_count": [
        r"\b(\d+)\s+rooms?\s+(?:of\s+which|in\s+total|total)",
        r"(?:total\s+(?:no\.?\s+of\s+)?rooms?|number\s+of\s+rooms?)\s*[\s:\-=>]*\s*(\d+)",
    ],
    "living_rooms_count": [
        r"\bliving\s+rooms?\s*[\s:\-=>]+\s*(\d+)",
        r"\b(\d+)\s+living\s+rooms?\b",
        r"(?:no\.?\s+of\s+living\s+rooms?|number\s+of\s+living\s+rooms?)\s*[\s:\-=>]*\s*(\d+)",
    ],
    "kitchens_count": [
        r"\bkitchens?\s*[\s:\-=>]+\s*(\d+)",
        r"\b(\d+)\s+kitchens?\b",
        r"(?:no\.?\s+of\s+kitchens?|number\s+of\s+kitchens?)\s*[\s:\-=>]*\s*(\d+)",
    ],
    "beds_count": [
        r"(?:number\s+of\s+beds?|no\.?\s+of\s+beds?)\s*[\s:\-=>]*\s*(?:min\s+)?(\d+)",
        r"\b(\d+)\s+beds?\s+(?:total|in\s+total|capacity|max)",
    ],
    "renovation_year": [
        r"(?:last\s+renovation\s*/\s*year|renovation\s+year|year\s+of\s+renovation)\s*[\s:\-=>]*\s*(19\d{2}|20\d{2})",
        r"(?:renovated|refurbished|ανακαινισμένο|ανακαινίσθηκε)\s+(?:in\s+|the\s+year\s+|το\s+)?(19\d{2}|20\d{2})",
    ],
}

# Fixed values. Types: the most matches win, the earlier of equals.
TYPES = {
    "Hotel/Commercial": [r"\b(?:hotels?|ξενοδοχεί[οα]|commercial|επαγγελματικός χώρος)\b"],
    "Maisonette": [r"\b(?:maisonettes?|μεζονέτ[αες]|mezonet[aes])\b"],
    "Townhouse": [r"\b(?:townhouses?|συγκρότημα(?: κατοικιών)?)\b"],
    "Detached House": [r"\b(?:detached houses?|μονοκατοικία|single family homes?)\b"],
    "Apartment": [r"\b(?:apartments?|flats?|διαμέρισμα(?:τα)?)\b"],
    "Villa": [r"\b(?:villas?|βίλ[αες]|βιλ[αες])\b"],
    "Studio": [r"\b(?:studios?|στούντιο|γκαρσονιέρα)\b"],
    "Land/Plot": [r"\b(?:plots?|lands?|parcels?|οικόπεδ[οα]|αγροτεμάχι[οα])\b"],
}

# Fixed values. Features that a text has or not.
FEATURES = {
    "helipad": [r"\b(?:helipad|heliport|helicopter landing pad|ελικοδρόμιο)\b"],
    "private_marina": [r"\b(?:private marina|private dock|pier|boat slip|ιδιωτική μαρίνα|μαρίνα|προβλήτα)\b"],
    "swimming_pool": [r"\b(?:pool|swimming pool|private pool|shared pool|πισίνα|ιδιωτική πισίνα)\b"],
    "parking": [r"\b(?:parking|garage|carport|πάρκινγκ|στάθμευση|γκαράζ)\b"],
    "air_conditioning": [r"\b(?:a/c|air condition(?:ing)?|klima|κλιματισμός|κλιματιστικό|aircon|air-conditioned)\b"],
    "heating": [r"\b(?:heating|central heating|underfloor heating|θέρμανση|ενδοδαπέδια|καλοριφέρ|heat pump|αντλία θερμότητας)\b"],
    "fireplace": [r"\b(?:fireplaces?|τζάκι(?:α)?)\b"],
    "furnished": [r"\b(?:fully furnished|furnished|επιπλωμένο|πλήρως επιπλωμένο)\b"],
    "alarm_system": [r"\b(?:alarm|security system|cctv|συναγερμός|κάμερες|σύστημα ασφαλείας)\b"],
    "garden": [r"\b(?:gardens?|landscaped garden|yard|κήπος|αυλή)\b"],
    "bbq": [r"\b(?:bbq|barbeque|barbecue|μπάρμπεκιου|ψησταριά)\b"],
    "solar_panels": [r"\b(?:solar(?: panels?)?|solar water heater|ηλιακός|ηλιακός θερμοσίφωνας)\b"],
    "sea_view": [r"\b(?:sea view|ocean view|panoramic sea view|view to the sea|view of the sea|θέα θάλασσα|απεριόριστη θέα)\b"],
    "elevator": [r"\b(?:elevators?|lifts?|ασανσέρ|ανελκυστήρας)\b"],
    "storage_room": [r"\b(?:storage(?: room)?|αποθήκη)\b"],
    "playroom": [r"\b(?:playrooms?|πλέιρουμ|play room)\b"],
    "renovated": [r"\b(?:renovated|recently renovated|refurbished|ανακαινισμένο|πλήρως ανακαινισμένο)\b"],
    "smart_home": [r"\b(?:smart home|έξυπνο σπίτι|home automation)\b"],
    "gym": [r"\b(?:gym|fitness room|γυμναστήριο)\b"],
    "jacuzzi_sauna": [r"\b(?:jacuzzi|sauna|hammam|τζακούζι|σάουνα|χαμάμ)\b"],
    "mosquito_nets": [r"\b(?:mosquito nets?|fly screens?|window screens?|σίτες?|σιτες?)\b"],
    "awnings": [r"\b(?:awnings?|sunshades?|τέντες?|τεντες?)\b"],
    "security_door": [r"\b(?:security door|armored door|πόρτα ασφαλείας|θωρακισμένη πόρτα)\b"],
    "water_well": [r"\b(?:water well|drilling|borehole|γεώτρηση|well\b)\b"],
    "wine_cellar": [r"\b(?:wine cellar|wine room|cava|κάβα|κελάρι)\b"],
    "home_cinema": [r"\b(?:home cinema|movie room|home theater|σινεμά|home theatre)\b"],
    "staff_quarters": [r"\b(?:maid's room|staff quarters|service room|staff room|δωμάτιο υπηρεσίας|δωμάτιο προσωπικού)\b"],
    "infinity_pool": [r"\b(?:infinity pool|overflow pool|υπερχείλιση|πισίνα υπερχείλισης)\b"],
    "tennis_court": [r"\b(?:tennis court|basketball court|padel court|sports court|γήπεδο τένις|γήπεδο μπάσκετ)\b"],
    "private_beach": [r"\b(?:private beach|direct access to (?:the )?sea|front line|ιδιωτική παραλία|πρώτο στη θάλασσα|άμεση πρόσβαση στη θάλασσα)\b"],
    "walk_in_closet": [r"\b(?:walk-in closet|dressing room|walk in closet|βεστιάριο)\b"],
    "ev_charger": [r"\b(?:ev charger|electric car charging|φόρτιση ηλεκτρικού αυτοκινήτου|wallbox)\b"],
    "guest_house": [r"\b(?:guest house|independent guest house|guesthouse|ξενώνας|αυτόνομος ξενώνας)\b"],
    "smart_locking": [r"\b(?:fingerprint lock|keyless entry|smart lock|έξυπνη κλειδαριά)\b"],
    "indoor_pool": [r"\b(?:indoor pool|heated pool|εσωτερική πισίνα|θερμαινόμενη πισίνα)\b"],
    "landscape_design": [r"\b(?:landscaped garden|automatic irrigation|botanical garden|αυτόματο πότισμα|αρχιτεκτονική τοπίου)\b"],
    "beachfront": [r"\b(?:beachfront|sea\s*front|seafront|first line of (?:the )?beach|just in front of the beach|on the (?:water|sea)front|by the sea\b|on the beach)\b"],
    "solarium": [r"\b(?:solariums?|σολάριουμ|σολαριουμ)\b"],
    "balcony": [r"\b(?:balcon(?:y|ies)|μπαλκόνι|βεραντούλα)\b"],
    "terrace": [r"\b(?:terraces?|covered terraces?|βεράντα|ταράτσα)\b"],
    "wifi": [r"\b(?:wi-?fi|wireless internet|wlan|ασύρματο\s+(?:internet|δίκτυο))\b"],
    "tv_satellite": [r"\b(?:satellite tv|sat tv|sky\s*tv|δορυφορική τηλεόραση)\b"],
    "dishwasher": [r"\b(?:dishwashers?|machine for dishes|πλυντήριο πιάτων)\b"],
    "washing_machine": [r"\b(?:washing machines?|automatic washing|laundry machines?|πλυντήρ[ιί][οα] ρούχων)\b"],
    "sun_deck": [r"\b(?:sun ?decks?|wooden deck|sundeck|ξύλινο\s+ντεκ)\b"],
    "outdoor_dining": [r"\b(?:outdoor dining|covered dining area|al fresco dining|outdoor (?:lounge|seating))\b"],
    "hotel_restaurant": [r"\b(?:on-?site restaurant|hotel restaurant|hotel taverna|in-?house restaurant)\b"],
    "hotel_bar": [r"\b(?:pool bar|beach bar|lobby bar|hotel bar)\b"],
    "conference_center": [r"\b(?:conference (?:center|centre|rooms?|hall)|αίθουσα συνεδρίων|meeting rooms?)\b"],
    "spa": [r"\b(?:spa\s*(?:center|centre|facilities)?|wellness center|wellness centre)\b"],
    "pergola": [r"\b(?:pergolas?|πέργκολα)\b"],
    "outdoor_wc": [r"\b(?:outdoor|external|exterior)\s+(?:wc|toilet|bathroom)\b"],
    "marble_floor": [r"\bmarble\s+(?:floors?|flooring|tiles?)\b|\bflooring[^.\n]{0,40}marble\b"],
    "wooden_floor": [r"\b(?:wooden?|hardwood|parquet)\s+(?:floors?|flooring)\b|\bflooring[^.\n]{0,40}(?:wood|parquet)\b"],
}

# Fixed values. Data of the listing site.
SYSTEM = {
    "site_property_id": [
        r"(?:Property ID|Listing ID|Ref(?:erence)?\s*(?:No\.?)?|ID|Κωδικός Ακινήτου|Κωδ\.)\s*[:\-#]?\s*([A-Za-z0-9_-]+)"
    ],
    "last_updated": [
        r"(?:Last updated|Updated(?: on)?|Modified|Ημερομηνία ενημέρωσης|Ενημερώθηκε)\s*[:\-]?\s*([\d./-]+)"
    ]
}

# Fixed values. Substrings of places in the region.
REGION = (
    "halkidiki", "chalkidiki", "khalkidhiki", "chalkidice", "khalkidiki", "polygyros", "poligiros", "poliyiros", "poligyros", "polygiros",
    "nea propontida", "propontida", "propontyda", "kassandra", "cassandra", "kasandra", "kassandria", "kasandria", "sithonia", "sidonia", "sithonya",
    "aristotelis", "aristotle", "sani", "fokea", "nea fokea", "afitos", "athitos", "kallithea", "kriopigi", "polixrono", "polichrono", "xanioti",
    "chaniotis", "hanioti", "pefkochori", "pefkohori", "pallini", "palini", "agia paraskevi", "skioni", "nea skioni", "kalandra", "fourka", "posidi",
    "kassandrino", "loutra", "glarokavos", "xroussos", "chrousos", "megali kypsa", "siviri", "mola kaliva", "paliouri", "elani", "toroni", "torone",
    "porto koufo", "sykia", "sikia", "sarti", "neos marmaras", "nikiti", "agios nikolaos", "vourvourou", "ormos panagias", "tristinika",
    "porto carras", "metagitsi", "kalamitsi", "akti salonikiou", "elia", "parthenonas", "spathies", "kalogria", "arnea", "arnaia", "panagia",
    "ierissos", "amouliani", "ammouliani", "nea roda", "ouranoupolis", "ouranoupoli", "akanthos", "acanthus", "megali panagia", "palaiochori",
    "neochori", "varvara", "stanou", "olimpiada", "olympiada", "stagira", "stagiron", "gomatia", "stratoni", "stratoniki", "ksxiropotamo",
    "pyrgadikia", "kariotissa", "triglia", "nea triglia", "moudania", "mudania", "nea moudania", "nea kalikratia", "nea kallikrateia", "kallikrateia",
    "flogita", "dionisiou", "paralia dionisiou", "agios pavlos", "nea irakleia", "lakkoma", "nea gonia", "agios antonios", "portaria", "nea sillata",
    "nea tenedos", "tenedos", "eleochoria", "petralona", "krini", "nea plagia", "simantra", "agios panteleimonas", "portes", "zografou",
    "nea potidaia", "nea potidea", "giaialtra", "agios mamas", "sozopoli", "vergia", "scholari", "geoponika", "kiparissi", "akti", "galatista",
    "olinthos", "ormilia", "ormylia", "kalyves poligirou", "gerakini", "metamorfosi", "agios prodromos", "vrastama", "vavdos", "taxiarxis", "sana",
    "doupia", "marathousa", "krimni", "zervoxoria", "paleokastro", "psakoudia", "kellia", "vatoperio", "vatopedi", "galarinos",
)

# Fixed values. Category names by canonical category.
CATEGORIES = {
    "villa": ("Villa",),
    "maisonette": ("Maisonette",),
    "apartment": ("Apartment",),
    "studio": ("Studio",),
    "detached_house": ("Detached Home", "Detached House", "Bungalow"),
    "multi_unit_building": ("Apartment Complex", "Residential Building"),
    "residential_complex": ("Residential Complex",),
    "hotel": ("Hotel",),
    "commercial": ("Hotel/Commercial",),
    "land": ("Land/Plot",),
}

# Fixed values. Keys of mined features, and keys of structured ones that say the same.
SYNONYMS = {
    "swimming_pool": ("pool", "communal_pool", "private_pool"),
    "sea_view": ("view", "sea", "view_sea"),
    "parking": ("garage", "parking_spot", "outdoor_garage"),
    "alarm_system": ("alarm",),
    "storage_room": ("storage",),
    "air_conditioning": ("a_c", "ac"),
    "heating": ("central_heating",),
    "fireplace": ("fire_place",),
    "balcony": ("balconies",),
    "terrace": ("terraces",),
}
