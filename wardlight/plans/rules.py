"""The rule base: in which phase, on which condition, what is asserted and which labels gain how much.

Conditions and guards are SQL over boolean columns, one for each signal, asserted signal and helper.  A rule is
evaluated once, in order: no condition reads what itself or a later rule asserts (``forward_references`` checks it).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

PHASES = ("access_denied", "official", "brand_independent", "brand_dependent")
#: Labels in the order in which thresholds are looked at.
THRESHOLDS = {
    "Impersonation": 0.6,
    "Phishing": 0.5,
    "Scam": 0.5,
    "Fake_Shop": 0.45,
    "Recruitment_Fraud": 0.5,
    "Gambling": 0.6,
    "Pornography": 0.6,
    "Social_Profile_Redirection": 0.4,
    "Parking_Site": 0.4,
    "Access_Denied": 0.4,
    "Official": 0.7,
    "Other_Site": 0.4,
}
FALLBACK = ("Other_Site", 1.0, "residual_fallback")


@dataclass(frozen=True)
class Gain:
    label: str
    delta: float
    signal: str  # alternatives, separated by |: the first that is present
    guard: str = "true"


@dataclass(frozen=True)
class Rule:
    id: str
    phase: str
    condition: str
    asserts: str | None = None
    gains: tuple[Gain, ...] = ()


def _rules(phase: str, table: str) -> list[Rule]:
    """A rule a line: id; condition; asserted signal; gains "Label delta signal [guard]" separated by +."""
    out = []
    for line in filter(None, map(str.strip, table.strip().split("\n"))):
        name, condition, asserts, gains = (x.strip() for x in line.split(";"))
        own = []
        for g in filter(None, map(str.strip, gains.split(" + "))):
            label, delta, signal, guard = re.fullmatch(r"(\w+) ([\d.]+) ([\w|]+)(?: \[(.*)\])?", g).groups()
            own.append(Gain(label, float(delta), signal, guard or "true"))
        out.append(Rule(name, phase, condition, asserts or None, tuple(own)))
    return out


#: What conditions are made of; each reads signals, asserted signals and helpers above it.
HELPERS = {
    "brand_claim": "brand_name_present or brand_image_detected or brand_in_markup",
    "strong_brand_claim": "brand_name_present or brand_image_detected",
    "impersonation_scorable": "impersonation_candidate and not impersonation_exempt",
    "fake_shop_scorable": "brand_claim and shop_storefront_context and not scam_exempt",
    "scam_scorable": "brand_claim and not scam_exempt",
    "parking_scorable": "not (has_password_input and semantic_credential_login_language_detected)",
    "scam_risk": "is_newly_registered or young_domain or is_short_term_registration or has_hidden_registrant or is_hosted_on_bulletproof or no_email_capability or missing_trust_navigation or error_trust_navigation or missing_copyright",
    "scam_extraction": "semantic_fee_collection_language_detected or semantic_recruitment_fee_language_detected or semantic_support_payment_scam_language_detected or offplatform_chat_contact or free_webmail_contact or conversion_destination_dead or excessive_dead_links",
    "scam_lure": "semantic_investment_scam_language_detected or semantic_reward_or_grant_scam_language_detected or semantic_official_brand_tone_detected or (impersonation_scorable and strong_brand_claim)",
    "credential_cue": "has_password_input or has_otp_input or has_username_input or semantic_credential_login_language_detected or semantic_credential_capture_language_detected",
    "young": "is_newly_registered or young_domain or is_short_term_registration",
    "credential_entry": "has_password_input or has_otp_input or semantic_credential_login_language_detected",
}

RULES: list[Rule] = [
    *_rules("access_denied", """
        access_denied_http_status; http_access_denied_status; ; Access_Denied 0.8 http_access_denied_status
        access_denied_dns_sinkhole; dns_sinkhole_detected; ; Access_Denied 0.8 dns_sinkhole_detected
    """),
    *_rules("official", """
        official_tls_org_identity; trusted_infra and brand_tls_org_match and has_enterprise_tls; official_brand_identity; Official 0.8 brand_tls_org_match
        official_registrant_org_identity; trusted_infra and brand_registrant_org_match and (has_enterprise_tls or established_domain); official_brand_identity; Official 0.75 brand_registrant_org_match
        official_brand_logo; trusted_infra and brand_image_detected; official_brand_logo_claim; Official 0.4 brand_image_detected
        official_brand_name_text; trusted_infra and brand_name_present; official_brand_name_claim; Official 0.4 brand_name_present
        official_brand_in_markup; trusted_infra and brand_in_markup; official_brand_markup_claim; Official 0.4 brand_in_markup
    """),
    *_rules("brand_independent", """
        adult_definitive_keywords; definitive_adult_language; ; Pornography 0.7 definitive_adult_language
        adult_content_language; semantic_adult_content_language_detected; ; Pornography 0.7 semantic_adult_content_language_detected
        adult_strong_keywords; strong_adult_language; ; Pornography 0.45 strong_adult_language [not adult_strong_many] + Pornography 0.65 strong_adult_language [adult_strong_many]
        adult_weak_prior; weak_adult_language; ; Pornography 0.15 weak_adult_language
        adult_age_gate; adult_age_gate_detected; ; Pornography 0.25 adult_age_gate_detected
        adult_tld; adult_tld_detected; ; Pornography 0.35 adult_tld_detected
        adult_dense_gallery; dense_media_gallery; ; Pornography 0.2 dense_media_gallery
        gambling_definitive_keywords; definitive_gambling_language; ; Gambling 0.7 definitive_gambling_language
        gambling_semantic; semantic_gambling_language_detected; ; Gambling 0.65 semantic_gambling_language_detected
        gambling_strong_keywords; strong_gambling_language; ; Gambling 0.45 strong_gambling_language [not gambling_strong_many] + Gambling 0.65 strong_gambling_language [gambling_strong_many]
        gambling_weak_prior; weak_gambling_language; ; Gambling 0.15 weak_gambling_language
        parking_candidate_gate; parking_keywords_present; parking_candidate;
        parking_semantic_primary; parking_scorable and parking_candidate and semantic_parking_language_detected; ; Parking_Site 0.7 semantic_parking_language_detected
        parking_infra_ip; parking_scorable and parking_candidate and parked_ip_detected; ; Parking_Site 0.45 parked_ip_detected
        parking_infra_ns; parking_scorable and parking_candidate and parked_nameservers_detected; ; Parking_Site 0.3 parked_nameservers_detected
        parking_no_email; parking_scorable and parking_candidate and (no_email_infrastructure or no_email_capability); ; Parking_Site 0.2 no_email_infrastructure|no_email_capability
        parking_transaction_buddy; parking_scorable and parking_candidate and semantic_transaction_language_detected; ; Parking_Site 0.2 semantic_transaction_language_detected
    """),
    *_rules("brand_dependent", """
        impersonation_gate; brand_claim; impersonation_candidate;
        commentary_exemption; brand_name_present and not has_password_input and not has_otp_input and not has_financial_input and not semantic_urgency_language_detected; impersonation_exempt;
        established_third_party; brand_claim and established_domain and has_enterprise_tls; impersonation_exempt;
        visual_brand_claim_prior; impersonation_scorable and brand_image_detected; visual_brand_claim; Impersonation 0.3 visual_brand_claim
        deceptive_subdomain_spoof; impersonation_scorable and is_subdomain and credential_entry; deceptive_subdomain; Impersonation 0.7 deceptive_subdomain
        stolen_face_tls_mismatch; impersonation_scorable and strong_brand_claim and tls_identity_mismatch; stolen_face_tls; Impersonation 0.7 stolen_face_tls
        the_phishing_trap; impersonation_scorable and strong_brand_claim and credential_entry; phishing_trap; Impersonation 0.45 phishing_trap + Phishing 0.4 phishing_trap
        the_burner_corporation; impersonation_scorable and strong_brand_claim and young and has_hidden_registrant; burner_corporation; Impersonation 0.55 burner_corporation
        geographic_imposter; impersonation_scorable and strong_brand_claim and (country_mismatch or is_hosted_on_bulletproof); geographic_imposter; Impersonation 0.5 geographic_imposter
        credential_capture; brand_claim and (has_password_input or has_otp_input or has_username_input or has_email_input or semantic_credential_login_language_detected or semantic_credential_capture_language_detected); ; Phishing 0.4 credential_capture
        phishing_sensitive_inputs; brand_claim and (has_financial_input or has_identity_input or has_file_upload); ; Phishing 0.3 has_financial_input|has_identity_input|has_file_upload
        disabled_autocomplete; brand_claim and has_password_input and disabled_autocomplete; ; Phishing 0.4 disabled_autocomplete
        external_form_submission; brand_claim and external_form_submission; ; Phishing 0.4 external_form_submission
        urgency_account_lure; brand_claim and (semantic_coercive_urgency_language_detected or semantic_credential_capture_language_detected) and (semantic_account_verification_language_detected or semantic_password_reset_language_detected or semantic_account_lockout_language_detected); ; Phishing 0.4 urgency_account_lure
        account_verification_language; brand_claim and (semantic_account_verification_language_detected or semantic_credential_capture_language_detected); ; Phishing 0.4 account_verification_language + Phishing 0.4 credential_capture
        password_reset_language; brand_claim and semantic_password_reset_language_detected; ; Phishing 0.4 password_reset_language
        legitimate_business_exemption; established_domain or has_enterprise_tls; scam_exempt;
        scam_investment_language; scam_scorable and semantic_investment_scam_language_detected and (scam_risk or scam_extraction); ; Scam 0.05 semantic_investment_scam_language_detected
        scam_reward_language; scam_scorable and semantic_reward_or_grant_scam_language_detected and (scam_risk or scam_extraction); ; Scam 0.1 semantic_reward_or_grant_scam_language_detected
        scam_brand_claim; scam_scorable and impersonation_scorable and strong_brand_claim and (scam_risk or scam_extraction); ; Scam 0.1 brand_impersonation_scam_lure
        scam_official_tone_boost; scam_scorable and semantic_official_brand_tone_detected and not has_enterprise_tls and (scam_risk or scam_extraction); ; Scam 0.1 semantic_official_brand_tone_detected
        scam_fee_language; scam_scorable and scam_risk and (semantic_fee_collection_language_detected or semantic_recruitment_fee_language_detected); ; Scam 0.15 semantic_fee_collection_language_detected|semantic_recruitment_fee_language_detected
        scam_support_payment; scam_scorable and scam_risk and semantic_support_payment_scam_language_detected; ; Scam 0.15 semantic_support_payment_scam_language_detected
        scam_offplatform_chat; scam_scorable and scam_risk and offplatform_chat_contact; ; Scam 0.25 offplatform_chat_contact
        scam_free_webmail; scam_scorable and scam_risk and free_webmail_contact; ; Scam 0.15 free_webmail_contact
        scam_conversion_destination_dead; scam_scorable and scam_risk and conversion_destination_dead; ; Scam 0.15 conversion_destination_dead
        scam_excessive_dead_links; scam_scorable and scam_risk and excessive_dead_links; ; Scam 0.15 excessive_dead_links
        scam_young_domain; scam_scorable and (scam_extraction or scam_lure) and young; ; Scam 0.15 is_newly_registered|young_domain|is_short_term_registration
        scam_hidden_registrant; scam_scorable and (scam_extraction or scam_lure) and has_hidden_registrant; ; Scam 0.15 has_hidden_registrant
        scam_bulletproof; scam_scorable and (scam_extraction or scam_lure) and is_hosted_on_bulletproof; ; Scam 0.1 is_hosted_on_bulletproof
        scam_no_email; scam_scorable and (scam_extraction or scam_lure) and no_email_capability; ; Scam 0.1 no_email_capability
        impersonation_scam_fee_trap; impersonation_scorable and strong_brand_claim and (semantic_fee_collection_language_detected or semantic_reward_or_grant_scam_language_detected or semantic_investment_scam_language_detected or semantic_support_payment_scam_language_detected); ; Impersonation 0.25 impersonation_scam_fee_trap
        shop_storefront_context; ecommerce_schema_present or pricing_patterns_present or semantic_transaction_language_detected; shop_storefront_context;
        fake_shop_suspicious_tld; fake_shop_scorable and suspicious_shop_tld; ; Fake_Shop 0.15 suspicious_shop_tld
        fake_shop_urgency; fake_shop_scorable and semantic_urgency_language_detected; ; Fake_Shop 0.15 semantic_urgency_language_detected
        fake_shop_free_webmail; fake_shop_scorable and free_webmail_contact; ; Fake_Shop 0.2 free_webmail_contact
        fake_shop_no_https; fake_shop_scorable and no_https; ; Fake_Shop 0.2 no_https
        fake_shop_trust_hollow; fake_shop_scorable and (missing_trust_navigation or error_trust_navigation); ; Fake_Shop 0.25 missing_trust_navigation|error_trust_navigation
        fake_shop_unrealistic_discount; fake_shop_scorable and unrealistic_discount_detected; ; Fake_Shop 0.25 unrealistic_discount_detected + Scam 0.1 unrealistic_discount_detected
        fake_shop_young_domain; fake_shop_scorable and young; ; Fake_Shop 0.2 is_newly_registered|young_domain|is_short_term_registration
        recruitment_language_prior; scam_scorable and semantic_recruitment_language_detected; ; Recruitment_Fraud 0.15 semantic_recruitment_language_detected
        recruitment_advance_fee; scam_scorable and semantic_recruitment_language_detected and (semantic_recruitment_fee_language_detected or semantic_fee_collection_language_detected or has_financial_input); advance_fee_recruitment_trap; Recruitment_Fraud 0.35 advance_fee_recruitment_trap + Scam 0.15 advance_fee_recruitment_trap
        recruitment_pii_harvest; scam_scorable and semantic_recruitment_language_detected and (has_identity_input or has_file_upload) and young; excessive_identity_harvesting; Recruitment_Fraud 0.3 excessive_identity_harvesting
        recruitment_hollow_portal; scam_scorable and semantic_recruitment_language_detected and strong_brand_claim and (no_email_capability or missing_trust_navigation or error_trust_navigation); hollow_recruiter_portal; Recruitment_Fraud 0.2 hollow_recruiter_portal
        recruitment_brand_impersonation; scam_scorable and hollow_recruiter_portal and (advance_fee_recruitment_trap or excessive_identity_harvesting); recruitment_brand_impersonation; Impersonation 0.35 recruitment_brand_impersonation
        trust_nav_missing; missing_trust_navigation; ; Scam 0.15 missing_trust_navigation [scam_scorable and (scam_extraction or scam_lure)] + Impersonation 0.25 missing_trust_navigation [impersonation_scorable] + Phishing 0.2 missing_trust_navigation [brand_claim and (credential_cue or impersonation_scorable)] + Recruitment_Fraud 0.15 missing_trust_navigation [scam_scorable and semantic_recruitment_language_detected]
        trust_nav_error; error_trust_navigation; ; Scam 0.1 error_trust_navigation [scam_scorable and (scam_extraction or scam_lure)] + Impersonation 0.2 error_trust_navigation [impersonation_scorable] + Phishing 0.15 error_trust_navigation [brand_claim and (credential_cue or impersonation_scorable)] + Recruitment_Fraud 0.1 error_trust_navigation [scam_scorable and semantic_recruitment_language_detected]
        missing_copyright_prior; missing_copyright; ; Scam 0.1 missing_copyright [scam_scorable and (scam_extraction or scam_lure)] + Impersonation 0.2 missing_copyright [impersonation_scorable]
        excessive_dead_links_prior; excessive_dead_links; ; Impersonation 0.25 excessive_dead_links [impersonation_scorable] + Phishing 0.15 excessive_dead_links [brand_claim and (credential_cue or impersonation_scorable)]
        conversion_destination_dead_prior; conversion_destination_dead; ; Impersonation 0.2 conversion_destination_dead [impersonation_scorable]
    """),
]
