"""A small master of institutions and targets that reach every rule of the cascade, for the registered queries and the tests (names are made up)."""

from __future__ import annotations

#: master_id, name, city, state, short_form, category
MASTER = [
    (1, "Alpha Valley College", "Pune", "Maharashtra", "AVC", ""),
    (2, "Beta Hills College", "Pune", "Maharashtra", "", ""),
    (3, "Beta Hills College", "Indore", "Madhya Pradesh", "", ""),
    (4, "Gamma Institute of Technology", "Bhopal", "Madhya Pradesh", "", ""),
    (5, "Indian Institute of Technology", "Hyderabad", "Telangana", "IIT Hyderabad", "Institute"),
    (6, "Jadavpur University", "Calcutta", "West Bengal", "JU Kolkata", "University"),
    (7, "Amity University", "Jaipur", "Rajasthan", "AU Jaipur", "University"),
    (8, "Amity School of Business", "Jaipur", "Rajasthan", "ASB", "College"),
    (9, "National Institute of Technology", "Hamirpur", "Himachal Pradesh", "NIT Hamirpur", "Institute"),
    (10, "National Institute of Technology Barch Wing", "Hamirpur", "Himachal Pradesh", "NIT Hamirpur B Arch", "Institute"),
    (11, "Department of Management, Indian Institute of Technology", "Hyderabad", "Telangana", "IIT DoM", "Institute"),
    (12, "Lakshmi Narain Medical College and Research Centre", "Bhopal", "Madhya Pradesh", "LNMCRC", "Medical"),
    (13, "Gandhi Medical College", "Bhopal", "Madhya Pradesh", "GMC Bhopal", "Medical"),
    (14, "SJB Institute of Technology", "Bangalore", "Karnataka", "SJBIT", ""),
    (15, "SJB College of Nursing", "Bangalore", "Karnataka", "SJBCN", ""),
    (16, "Orion University Online", "New Delhi", "Delhi", "", "University"),
    (17, "Orion University", "New Delhi", "Delhi", "OUD", "University"),
    (18, "Mehr College - [Alpha Bravo Charlie]", "Chandigarh", "Punjab", "", ""),
    (19, "Delta Polytechnic Institute", "Nagpur", "Maharashtra", "DPI Nagpur", ""),
    (20, "Kalinga Memorial College of Engineering", "Cuttack", "Odisha", "KMCE", ""),
    (21, "Kalinga Memorial College of Nursing", "Cuttack", "Odisha", "KMCN", ""),
    (22, "Sunrise Arts College Autonomous", "Nashik", "Maharashtra", "", ""),
    (23, "St. Xavier's College", "Mumbai", "Maharashtra", "SXC", ""),
    (24, "Department of Physics, Omega University", "Surat", "Gujarat", "", ""),
    (25, "Omega University", "Surat", "Gujarat", "OMU", "University"),
    (26, "Omega Institute of Law", "Surat", "Gujarat", "", ""),
    (27, "Tagore Institute of Information Technology", "Kolkata", "West Bengal", "TIIT", ""),
    (28, "P.E.S. College of Pharmacy", "Mysore", "Karnataka", "PESCOP", ""),
    (29, "Vega Dental College & Hospital", "Indore", "Madhya Pradesh", "VDCH", ""),
    (30, "Vega Dental College & Hospital", "Indore", "Madhya Pradesh", "Vega Dental College and Hospital", ""),
    (31, "IBS", "Hyderabad", "Telangana", "", ""),
    (32, "Institute of Business Studies", "Hyderabad", "Telangana", "", ""),
    (33, "Nova College", "", "Kerala", "Nova Kochi", ""),
    (34, "Nova Trust College LNCT Bhopal", "", "Madhya Pradesh", "", ""),
    (35, "Rigel Homoeopathic Medical College", "Lucknow", "Uttar Pradesh", "RHMC", ""),
    (36, "Rigel Ayurveda College", "Lucknow", "Uttar Pradesh", "RAC", ""),
    (37, "Polaris School of Planning", "Bhopal", "Madhya Pradesh", "PSP", ""),
    (38, "Polaris University", "Bhopal", "Madhya Pradesh", "PUB", "University"),
    (39, "Birla Institute of Technology and Science", "Pilani", "Rajasthan", "BITS Pilani", "University"),
    (40, "Altair Academy", "Noida", "Uttar Pradesh", "ALTA", ""),
    (41, "Altair Academy", "Gurgaon", "Haryana", "ALTG", ""),
    (42, "Castor Pollux Women College", "Ujjain", "Madhya Pradesh", "", ""),
    (43, "Castor Pollux Boys College", "Ujjain", "Madhya Pradesh", "", ""),
    (44, "Deneb College", "Surat", "Gujarat", "", ""),
    (44, "Deneb Evening College", "Ujjain", "Madhya Pradesh", "DEC", ""),
    (45, "Mira Teachers' College", "Greater Noida", "Uttar Pradesh", "", ""),
    (46, "Vikram Arjun Bhima Nakul Karna Drona Kripa Shalya Sanjaya Vidura Shakuni College", "Ujjain", "Madhya Pradesh", "", ""),
    (57033, "L.N. Medical College", "Bhopal", "Madhya Pradesh", "", "Medical"),
    (4639, "Sophia College", "Mumbai", "Maharashtra", "", ""),
    (54797, "Amity Campus", "Lucknow", "Uttar Pradesh", "", "University"),
    (58702, "Peoples College of Dental Sciences", "Bhopal", "Madhya Pradesh", "PCDS", ""),
]
#: name, city, state
CASES = [
    ("Alpha Valley College", "", ""), ("  ALPHA   valley COLLEGE ", "", ""), ("College Alpha Valley", "", ""), ("Alpha Valley College", "Pune", "MH"), ("Alpha Valley College", "Pune", "Maharashtra"), ("Alpha Valley College", "Jaipur", ""),
    ("Beta Hills College", "", ""), ("Beta Hills College", "Indore", ""), ("Beta Hills College", "Bhopal", ""), ("Gamma Institute of Technology", "Jaipur", ""), ("GammaInstitute of Technology", "", ""), ("Gamma Insitute of Technology Private Limited", "Bhopal", ""),
    ("IIT", "Hyderabad", ""), ("IIT Hyderabad", "", ""), ("Indian Institute of Technology, Hyderabad", "", ""), ("Department of Management, IIT Hyderabad", "", ""), ("NIT Hamirpur", "", ""), ("Faculty of Architecture, NIT", "Hamirpur", ""), ("NIT", "Hamirpur", ""), ("Law Wing NIT Hamirpur", "", ""),
    ("BITS", "Pilani", ""), ("AIIMS", "Bhopal", ""), ("Amity Faculty of Commerce", "Jaipur", ""), ("Amity University", "Noida", ""), ("Amity University Noida", "", ""), ("Amity Business", "", ""),
    ("LN Medical College Bhopal", "", ""), ("LN Medical College", "Bhopal", ""), ("L.N. Medical College", "Bhopal", ""), ("LNMC Medical", "Bhopal", ""), ("LNMCRC", "Indore", ""), ("LNM Medical Hospital", "Bhopal", ""),
    ("Social Communications Media Department SCM Sophia Mumbai", "", ""), ("Social Communications Media Department SCM Sophia", "Mumbai", ""), ("ISBM College of Engineering Pune Pune", "", ""), ("ISBM College of Engineering Pune", "Pune", ""), ("Peoples College of Dental Sciences and Research Centre", "Bhopal", ""),
    ("Faculty of Engineering, Jadavpur University", "", ""), ("Faculty of Engineering Jadavpur University Kolkata", "", ""), ("Faculty of Engineering Jadavpur University", "", ""), ("Centre for Comets, Jadavpur University, Kolkata", "", ""), ("Space Wing, JADAVPUR UNIVERSITY", "", ""), ("Jadavpur University", "Mumbai", ""), ("Space Wing, LNMCRC", "", ""),
    ("SJB College", "Bengaluru", ""), ("SJB Engineering", "Bengaluru", ""), ("SJB", "Bangalore", ""), ("SJBIT", "", ""), ("SJB Institute of Nursing", "", ""), ("Orion", "Delhi", ""), ("Orion University", "", ""), ("Orion University Online", "", ""), ("Online Orion University Delhi", "", ""), ("Orion Distance University", "", ""),
    ("Mehr College", "", ""), ("Mehr College", "Chandigarh", ""), ("Bravo Charlie", "", ""), ("Alpha Bravo Charlie", "", ""), ("ABC", "", ""), ("Delta Polytechnic", "Nagpur", ""), ("Delta Polytechnik Institute", "", ""), ("DPI", "Nagpur", ""), ("DPI Nagpur Wing", "", ""), ("Delta Institute", "", ""),
    ("Kalinga Memorial College", "Cuttack", ""), ("KMCE Campus", "Cuttack", ""), ("Kalinga Memorial", "", ""), ("Kalinga College of Engineering", "Nagpur", ""), ("KMCE", "Nagpur", ""), ("KMCE Engineering", "Nagpur", ""), ("Kalinga Memorial Engineering Trust of Odisha", "", ""),
    ("Sunrise Arts College", "Nashik", ""), ("Sunrise Arts College (Autonomous)", "", ""), ("Sunrise Arts", "", ""), ("St. Xavier's College", "Mumbai", ""), ("St Xaviers College", "Bombay", ""), ("St Xavier’s College", "", ""), ("SXC", "Kolkata", ""),
    ("Department of Physics, Omega University", "Surat", ""), ("Department of Chemistry, Omega University, Surat", "", ""), ("Omega University", "Surat", ""), ("Omega", "Surat", ""), ("Omega Law", "", ""), ("Omega Institute", "", ""), ("School of Law Omega University Surat", "", ""), ("School of Omega University", "", ""),
    ("Tagore Institute of Information Technology", "Calcutta", ""), ("Tagore IIT", "Kolkata", ""), ("P E S College of Pharmacy", "Mysuru", ""), ("PES College of Pharmacy", "", ""), ("P.E.S. Pharmacy", "", ""), ("Vega Dental College and Hospital", "Indore", ""), ("Vega Dental", "Indore", ""), ("VDCH", "", ""),
    ("IBS", "Hyderabad", ""), ("IBS Hyderabad", "", ""), ("Institute of Business Studies", "", ""), ("Nova", "Kochi", ""), ("Nova College", "Cochin", ""), ("Nova Trust College", "Bhopal", ""), ("LNCT", "Bhopal", ""), ("Nova College", "Pune", ""),
    ("Rigel Medical College", "Lucknow", ""), ("Rigel Homeopathic College", "", ""), ("Rigel College", "Lucknow", ""), ("Rigel", "", ""), ("Polaris School of Planning", "", ""), ("Polaris University - School College of Design", "", ""), ("Polaris University, Government College of Stars", "Bhopal", ""), ("Institute of Stars, Polaris University", "", ""),
    ("Altair Academy", "Noida", ""), ("Altair Academy", "Greater Noida", ""), ("Altair Academy", "", ""), ("Altair", "Gurugram", ""), ("ALTA Academy", "Gurgaon", ""), ("Castor Pollux College", "Ujjain", ""), ("Castor Pollux", "", ""), ("Castor Women", "Ujjain", ""), ("Deneb College", "", ""), ("Deneb College", "Ujjain", ""), ("Deneb", "Surat", ""),
    ("Mira Teachers College", "Noida", ""), ("Mira Teachers' College", "Greater Noida", ""), ("Zzyzx Qwerty", "", ""), ("Zzyzx Qwerty", "Pune", ""), ("Zzyzx Alphy", "", ""), ("College", "", ""), ("", "", ""), ("!!!", "Pune", ""), ("Pune", "", ""), ("Pune College", "Pune", ""), ("Gandhi Medical College", "Indore", ""), ("Gandhi College", "Bhopal", ""), ("Gandhi Memorial Engineering", "", ""),
    ("Vikram Arjun Bhima Nakul Karna", "", ""), ("lnmcr medical", "Bhopal", ""), ("kalinga memorial kmce", "Nagpur", ""), ("sjb nursing", "Bangalore", ""), ("rigel academy", "Lucknow", ""),
]
MASTER_SCHEMA = "master_id long, name string, city string, state string, short_form string, category string, _row_id long"
TARGET_SCHEMA = "row_id long, name string, city string, state string, note string"


def master_rows() -> list[tuple]:
    return [(*r, k) for k, r in enumerate(MASTER)]


def target_rows() -> list[tuple]:
    """The cases, some twice."""
    return [(k, *c, f"n{k}") for k, c in enumerate([*CASES, *CASES[::9]])]
