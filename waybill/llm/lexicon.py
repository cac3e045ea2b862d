"""Other usual names of the entries of the reference lists, one line an entry, names parted by semicolons."""

# Fixed values.
TEST = {
    "Assay": "assay content; content (assay); gehalt (assay); potency assay; potency",
    "Loss on Drying": "LOD; drying loss; loss on dry.; perte à la dessiccation; trocknungsverlust",
    "Residue on Ignition": "ROI; ignition residue; residue after ignition; sulphated ash; sulfated ash",
    "Water Content": "k.f. water; KF; water (kf); water determination; moisture by karl fischer; teneur en eau; wassergehalt; water",
    "Heavy Metals": "hvy. metals; heavy metals (as pb); hm limit; hm limit test; HM",
    "Related Substances": "r.s.; rel. subst.; related subs.; related impurities; verwandte substanzen",
    "Residual Solvents": "OVI; organic volatile impurities; solvent residues; resid. solvents; r. solvents",
    "Appearance": "aspect; physical appearance; visual appearance; appearence; aussehen; description",
    "Identification by IR": "id (ir); ident. infra-red spectrum; identity - infrared; ir identification; IR",
    "Identification by HPLC": "id (hplc); identity - retention time hplc; hplc identification; ident. hplc",
    "pH": "p.h.; ph value; ph of 1% solution; reaction (ph); ph-wert",
    "Specific Rotation": "SOR; spec. rotation; specific optical rotation; [alpha]d specific rot.; optical rotation",
    "Melting Range": "m.p.; melting point; melting temp.; fusion range; m.r.",
    "Total Aerobic Microbial Count": "TAMC; total viable aerobic count; aerobic plate count; total plate count",
    "Total Yeast and Mould Count": "TYMC; yeasts & molds; yeast/mould count; fungal count (tymc); yeast and mold count",
    "Bulk Density": "b.d. (bulk); apparent bulk dens.; untapped density; b.d.",
    "Tapped Density": "t.d. (tapped); tap density; density tapped; t.d.",
    "Particle Size": "PSD; particle size distr.; d90 particle size; granulometry; particle size distribution",
    "Bacterial Endotoxins": "BET; bact. endotoxins; endotoxin; endotoxins; LAL; lal test",
    "Solubility": "solub.; solubility profile; soluble in",
    "Clarity of Solution": "clarity of soln.; solution clarity; turbidity of solution",
    "Colour of Solution": "color of solution; solution color; soln. colour; solution colour",
    "Chloride": "chlorides; cl limit; limit of chloride",
    "Sulphate": "sulfate; sulphates; sulfates; so4 limit; limit of sulphate",
    "Iron": "iron (fe); fe content; limit of iron",
    "Arsenic": "arsenic (as); as content; limit of arsenic",
    "Lead": "lead (pb); pb content; limit of lead",
    "Enantiomeric Purity": "chiral purity; optical purity (ee); enantiom. purity; ee",
    "Viscosity": "visc.; kinematic visc.; viscosité; kinematic viscosity",
    "Refractive Index": "RI; refr. index; nd20 refraction",
    "Elemental Impurities": "elem. impurities; icp-ms metals; trace elements",
    "Nitrosamine Impurities": "nitrosamines; ndma/ndea; n-nitroso compounds",
    "Acidity or Alkalinity": "acidity/alkalinity; alkalinity or acidity; acid-alkali reaction",
    "Specific Surface Area": "SSA; bet surface; surface area (n2); surface area; bet surface area",
}
# Fixed values.
LABEL = {
    "Product Name": "prod. name; name of product; material; name of material; material name; produktname; product; name",
    "Batch Number": "batch no; batch #; b. no.; lot no.; lot#; lot number; charge; batch; lot; chargen-nr.",
    "Batch Size": "b. size; lot size; size of batch",
    "Manufacturing Date": "mfg date; mfg. dt.; DOM; date of manufacture; production date; date of mfg.; produced on; mfd.",
    "Expiry Date": "exp.; exp date; date of expiry; best before; use by; expiration date; exp. dt.; expires on",
    "Retest Date": "re-test date; retest due; date of re-evaluation; re-qualification date; retest; re-evaluation date",
    "Manufacturer": "mfr.; made by; manufactured by; producer; produced by; hersteller",
    "Storage Condition": "stor. cond.; storage; store at; keeping conditions; storage conditions",
    "CAS Number": "CAS; cas#; cas no.; c.a.s. no.; cas rn",
    "Certificate Number": "cert. no.; coa#; coa no; certificate ref.; certificate no.",
    "Analytical Report Number": "ar#; ar no; a.r. no.; analysis report #; analytical report no.",
    "Quantity": "qty; amount; quantité; menge",
    "Sampling Date": "sampled on; sample taken; date of sampling",
    "Analysis Date": "tested on; test date; test completion date; date of analysis; analysed on",
    "Release Date": "rel. date; released on; date of release",
    "Molecular Formula": "m.f.; mol. formula; empirical formula",
    "Molecular Weight": "m.w.; mol. wt.; FW; formula weight; MW",
    "Grade": "grd.; quality grade; pharmacopoeia grade",
    "Country of Origin": "COO; origin; made in; ctry of origin",
    "Remarks": "remark; rmks; comments; note; notes; bemerkungen",
    "Purchase Order Number": "po no; p.o. #; your order no.; buyer order ref; po number",
    "Container Count": "pkgs; number of containers; no. of drums; no. of containers; number of drums",
    "Net Weight": "n.w.; net wt; nett weight; net weight (kg)",
    "Gross Weight": "g.w.; gross wt; gr. weight",
    "Version Number": "ver.; version#; rev. no.; version; revision",
    "Approved By": "appr. by; authorised by; released by (qa); authorized by",
}
# Native, neighbouring languages' and formal names; two- and three-letter codes follow in CODES.
COUNTRY = {
    "China": "p.r. china; PRC; people's rep. of china; chine; people's republic of china",
    "India": "bharat; republic of india; indien; inde",
    "Germany": "deutschland; allemagne; fed. rep. of germany; ger; alemania; germania; BRD",
    "France": "frankreich; rép. française; francia; french republic",
    "Italy": "italia; italien; italie; rep. italiana",
    "Spain": "españa; spanien; espagne; reino de españa",
    "Switzerland": "schweiz; suisse; svizzera; swiss confed.; swiss confederation",
    "United Kingdom": "UK; u.k.; great britain; england; britain; vereinigtes königreich",
    "United States": "USA; u.s.a.; united states of america; etats-unis; estados unidos; vereinigte staaten",
    "Japan": "nippon; japon; nihon",
    "South Korea": "korea (south); rep. of korea; ROK; republic of korea; südkorea; corée du sud",
    "Brazil": "brasil; brésil; brasilien; rep. fed. do brasil",
    "Turkey": "türkiye; turquie; türkei",
    "Jordan": "hashemite kingdom of jordan; h.k. jordan; jordanie; jordanien",
    "Egypt": "misr; ägypten; arab rep. of egypt; égypte",
    "Netherlands": "the netherlands; holland; nederland; niederlande; pays-bas",
    "Belgium": "belgië; belgique; belgien",
    "Austria": "österreich; autriche",
    "Denmark": "danmark; dänemark; danemark",
    "Sweden": "sverige; schweden; suède",
    "Poland": "polska; polen; pologne",
    "Portugal": "rep. portuguesa; port.",
    "Mexico": "méxico; estados unidos mexicanos; mexiko; mexique",
    "Canada": "kanada",
    "Australia": "commonwealth of australia; australien; australie",
    "United Arab Emirates": "UAE; u.a.e.; emirates; émirats arabes unis; vereinigte arabische emirate",
    "Saudi Arabia": "KSA; k.s.a.; kingdom of saudi arabia; sa (saudi); saudi-arabien; saudi",
    "Taiwan": "formosa; taiwan r.o.c.; r.o.c.",
    "Singapore": "s'pore; singapur; singapour",
    "Ireland": "éire; irland; irlande; rep. of ireland",
    "Czechia": "česko; czech republic; tschechien; česká republika",
    "Hungary": "magyarország; ungarn; hongrie",
    "Slovenia": "slovenija; slowenien; slovénie",
    "Slovakia": "slovensko; slovak republic; slowakei; slovaquie",
    "Argentina": "rep. argentina; argentinien; argentine",
}
# ISO 3166 codes of these countries.
CODES = {
    "China": "CN CHN", "India": "IN IND", "Germany": "DE DEU", "France": "FR FRA", "Italy": "IT ITA", "Spain": "ES ESP", "Switzerland": "CH CHE", "United Kingdom": "GB GBR",
    "United States": "US", "Japan": "JP JPN", "South Korea": "KR KOR", "Brazil": "BR BRA", "Turkey": "TR TUR", "Jordan": "JO JOR", "Egypt": "EG EGY", "Netherlands": "NL NLD",
    "Belgium": "BE BEL", "Austria": "AT AUT", "Denmark": "DK DNK", "Sweden": "SE SWE", "Poland": "PL POL", "Portugal": "PT PRT", "Mexico": "MX MEX", "Canada": "CA CAN",
    "Australia": "AU AUS", "United Arab Emirates": "AE ARE", "Saudi Arabia": "SA SAU", "Taiwan": "TW TWN", "Singapore": "SG SGP", "Ireland": "IE IRL", "Czechia": "CZ CZE",
    "Hungary": "HU HUN", "Slovenia": "SI SVN", "Slovakia": "SK SVK", "Argentina": "AR ARG",
}


def aliases() -> list[tuple[str, str, str]]:
    """(kind, entry, other name)."""
    out = []
    for kind, table in (("test", TEST), ("label", LABEL), ("country", COUNTRY)):
        out += [(kind, entry, name.strip()) for entry, names in table.items() for name in names.split(";")]
    return out + [("country", entry, code) for entry, codes in CODES.items() for code in codes.split()]
